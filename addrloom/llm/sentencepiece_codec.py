"""SentencePiece BPE encoding with seeded merge dropout, and decoding.

White space is escaped as the model asks (a mark for each space and one in front), and the text is cut where no piece
of the model can reach across: before runs of marks and around line ends. Each unit is segmented by an agenda of
candidate merges, best score first, leftmost on ties; each candidate is skipped for good with probability `dropout`.
Characters outside the model, and marks that stand in the text itself, become byte pieces, so every segmentation
decodes to the very text.

The draws depend on the seed, the document id and the unit's place in the text, so every occurrence of a unit has its
own. They are drawn as gaps: how many candidates are kept before the next one is skipped has the geometric law that
separate draws would give. What a unit becomes depends on its gaps alone, so a bounded cache holds, for each unit, a
tree of the segmentations that occurred, one branch for each gap; a new branch replays the agenda. New nodes of one
batch are segmented together, one merge of each at a time, in arrays of symbols. One map over whole texts; no shuffle.
"""

from __future__ import annotations

import functools
import heapq
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import take_over

MARK = "▁"
DROPOUT, SEED = 0.1, 17
SCANNED = 24  # characters of a unit that is segmented without a heap
TOGETHER = 32  # units or more are segmented in arrays
MAX_UNIT = 200  # characters; longer units are segmented anew each time
_UNITS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_NEVER = 2**31 - 1
_STANDIN = "\udc80"  # in place of a mark that the text itself holds; no text of UTF-8 has a lone surrogate


class Codec:
    """Encoder and decoder of one model file; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 1_500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes_at, self.out = [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes_at[value] = i
                self.out.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.out.append(b"")
            else:
                self.rank[piece] = (-model.get_score(i), i)
                self.out.append(piece.replace(MARK, " ").encode())
        self.score = {piece: score for piece, (score, _) in self.rank.items()}
        self.limit = limit
        self._tables()
        self.forget()

    def _tables(self) -> None:
        """Symbols (pieces) as numbers, the symbol of each character, and for each pair that merges its order and result."""
        import numpy as np

        pieces = sorted(self.rank, key=lambda piece: self.rank[piece][0])
        symbol = {piece: at for at, piece in enumerate(pieces)}
        self.symbol_id = np.array([self.rank[piece][1] for piece in pieces], np.uint32)
        self.none = len(pieces)  # no symbol
        self.char_symbol = np.full(0x110000, self.none, np.int32)
        for piece, at in symbol.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = at
        # symbols of one score have one order: the leftmost goes first
        scores = np.array([self.rank[piece][0] for piece in pieces])
        self.order = np.concatenate(([0], np.cumsum(scores[1:] != scores[:-1]))).astype(np.int32) if pieces else np.empty(0, np.int32)
        self.order = np.append(self.order, np.int32(_NEVER))
        pairs = {}
        for piece, at in symbol.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.none + 1) + right] = at
        keys = sorted(pairs)
        # open addressing, so that a look-up touches one or two places
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.pair_key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.pair_symbol = np.full(len(self.pair_key), self.none, np.int32)
        left = np.array(keys, np.int64)
        slot = self._slot(left)
        while len(left):
            free = self.pair_key[slot] < 0
            self.pair_key[slot[free]] = left[free]
            stays = self.pair_key[slot] != left  # another pair has the place
            done = ~stays
            self.pair_symbol[slot[done]] = [pairs[key] for key in left[done].tolist()]
            left, slot = left[stays], (slot[stays] + 1) & (len(self.pair_key) - 1)

    def _slot(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(_STEP)) >> self.shift).astype(np.int64)

    def _merged(self, left, right):
        """The symbol that each pair of symbols merges to, or none."""
        import numpy as np

        keys = left.astype(np.int64) * (self.none + 1) + right
        slot = self._slot(keys)
        held = self.pair_key[slot]
        out = np.where(held == keys, self.pair_symbol[slot], np.int32(self.none))
        further = np.flatnonzero((held != keys) & (held >= 0))
        while len(further):
            slot[further] = (slot[further] + 1) & (len(self.pair_key) - 1)
            held = self.pair_key[slot[further]]
            hit = held == keys[further]
            out[further[hit]] = self.pair_symbol[slot[further[hit]]]
            further = further[~hit & (held >= 0)]
        return out

    def together(self, units: list[str], gaps) -> list[tuple[bytes, int]]:
        """(ids, candidates after the last skipped one) of each unit, as by segment; gaps: a row for each, all of one length."""
        import numpy as np

        sizes = np.array(list(map(len, units)), np.int64)
        symbols = self.char_symbol[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        fit = (sizes > 0) & (sizes <= SCANNED)
        fit[np.repeat(np.arange(len(units)), sizes)[symbols == self.none]] = False
        out: list = [None] * len(units)
        for at in np.flatnonzero(~fit).tolist():
            pieces, rest = self.segment(units[at], gaps[at].tolist())
            out[at] = self.ids_of(pieces), rest
        chosen = np.flatnonzero(fit)
        widths = -(-sizes[chosen] // 8) * 8
        for width in np.unique(widths).tolist():  # units of about one length fill a rectangle
            rows = chosen[widths == width]
            held = np.arange(width) < sizes[rows][:, None]
            parts = np.full((len(rows), width), self.none, np.int32)
            parts[held] = symbols[(starts[rows][:, None] + np.arange(width))[held]]
            flat, counts, rest = self._rectangle(parts, held, gaps[rows])
            ends = (np.cumsum(counts) * 4).tolist()
            begin = 0
            for at, end, left in zip(rows.tolist(), ends, rest.tolist(), strict=True):
                out[at] = flat[begin:end], left
                begin = end
        return out

    def _rectangle(self, parts, alive, gaps):
        """The ids of rows of symbols (alive: not only padding), how many each row has, and the candidates after each row's last skipped one."""
        import numpy as np

        many, size = parts.shape
        skips = gaps.shape[1]
        gaps = np.concatenate((gaps, np.full((many, 1), -1, np.int64)), axis=1)
        alive = np.pad(alive, ((0, 0), (0, 1)))
        since, turn, to_skip = np.zeros(many, np.int64), np.zeros(many, np.int64), gaps[:, 0].copy()
        none = self.none
        # column `size` is the end of a row: no symbol, and a place for what has no neighbour
        parts = np.concatenate((parts, np.full((many, 1), none, np.int32)), axis=1)
        result = np.full((many, size + 1), none, np.int32)  # of the pair that begins at a place
        result[:, : size - 1] = self._merged(parts[:, : size - 1].ravel(), parts[:, 1:size].ravel()).reshape(many, size - 1)
        order = self.order[result]
        after = np.tile(np.minimum(np.arange(1, size + 2), size), (many, 1))
        before = np.tile(np.concatenate((np.arange(-1, size - 1), [-1])), (many, 1))
        rows = np.arange(many)
        while len(rows):
            i = order[rows].argmin(axis=1)
            due = order[rows, i] < _NEVER
            rows, i = rows[due], i[due]
            skipped = to_skip[rows] == 0
            gone, place = rows[skipped], i[skipped]
            if len(gone):
                order[gone, place] = _NEVER
                turn[gone] += 1
                to_skip[gone] = gaps[gone, np.minimum(turn[gone], skips)]
                since[gone] = 0
            r, i = rows[~skipped], i[~skipped]
            to_skip[r] -= 1
            since[r] += 1
            j = after[r, i]
            parts[r, i] = joined = result[r, i]
            alive[r, j] = False
            order[r, j] = _NEVER
            k = after[r, j]
            after[r, i] = k
            before[r, k] = i
            result[r, i] = new = self._merged(joined, parts[r, k])
            order[r, i] = self.order[new]
            inner = before[r, i] >= 0
            r, joined, h = r[inner], joined[inner], before[r, i][inner]
            result[r, h] = new = self._merged(parts[r, h], joined)
            order[r, h] = self.order[new]
        return self.symbol_id[parts[alive]].tobytes(), alive.sum(axis=1), since

    def forget(self) -> None:
        """Empty the cache. A node is a unit with the gaps of its skipped candidates; a unit's root has none."""
        from array import array

        self.root: dict[str, int] = {}
        self.branch: dict[int, int] = {}  # node << 8 | gap: the node with that gap more
        self.ids, self.rest = [], array("i")  # of each node: its ids; the candidates after the last skipped one
        self.parent, self.gap = array("i"), array("i")

    def segment(self, unit: str, gaps=()) -> tuple[list[str], int]:
        """The pieces (or single characters) that a unit ends as, and how many candidates came after the last skipped one.

        gaps: how many candidates are kept before each skipped one.
        """
        gaps = iter(gaps)
        if len(unit) <= SCANNED:
            return self.scanned(unit, gaps)
        left_to_skip, since = next(gaps, -1), 0
        parts, rank, n = list(unit), self.rank, len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := rank.get(parts[i] + parts[j])):
                agenda.append((found[0], i, len(parts[i]), len(parts[j])))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(agenda)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i] if parts[i] else n
            if j >= n or len(parts[i]) != left or len(parts[j]) != right:
                continue
            if left_to_skip == 0:
                left_to_skip, since = next(gaps, -1), 0
                continue
            left_to_skip -= 1
            since += 1
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    size = len(agenda)
                    offer(k)
                    if len(agenda) > size:
                        heapq._siftdown(agenda, 0, size)
        return [p for p in parts if p], since

    def scanned(self, unit: str, gaps) -> tuple[list[str], int]:
        """segment by a look at all neighbours for each merge: faster than an agenda where there are few."""
        parts, score, never = list(unit), self.score.get, math.inf
        scores = [score(unit[i : i + 2], never) for i in range(len(unit) - 1)]
        left_to_skip, since = next(gaps, -1), 0
        while scores and (best := min(scores)) < never:
            i = scores.index(best)
            if left_to_skip == 0:
                scores[i], left_to_skip, since = never, next(gaps, -1), 0
                continue
            left_to_skip -= 1
            since += 1
            parts[i] = joined = parts[i] + parts.pop(i + 1)
            del scores[i]
            if i < len(scores):
                scores[i] = score(joined + parts[i + 1], never)
            if i:
                scores[i - 1] = score(parts[i - 1] + joined, never)
        return parts, since

    def ids_of(self, pieces: list[str]) -> bytes:
        from array import array

        ids = []
        for p in pieces:
            found = self.rank.get(p)
            if found:
                ids.append(found[1])
            else:
                ids.extend(self.bytes_at[b] for b in p.replace(_STANDIN, MARK).encode())
        return array("I", ids).tobytes()

    def node(self, unit: str, parent: int = -1, gap: int = 0, made: tuple[bytes, int] | None = None) -> int:
        """A new node: the unit's root, or the branch of `parent` for one more gap; made: its ids and its rest, if known."""
        if made is None:
            gaps, at = [gap] if parent >= 0 else [], parent
            while at >= 0 and self.parent[at] >= 0:
                gaps.append(self.gap[at])
                at = self.parent[at]
            pieces, rest = self.segment(unit, reversed(gaps))
            made = self.ids_of(pieces), rest
        new = len(self.ids)
        self.ids.append(made[0])
        self.rest.append(made[1])
        self.parent.append(parent)
        self.gap.append(gap)
        if parent < 0:
            self.root[unit] = new
        else:
            self.branch[parent << 8 | gap] = new
        return new

    def encode_units(self, units: list[str], first, dropout: float) -> list[bytes]:
        """The ids of each unit; first: a 64-bit draw for each, from which its gaps follow."""
        import numpy as np

        if len(self.ids) > self.limit:
            self.forget()
        fresh = [u for u in dict.fromkeys(units) if u not in self.root]
        long = dict.fromkeys((u for u in fresh if len(u) > MAX_UNIT), -1)
        fresh = [u for u in fresh if u not in long]
        made = self.together(fresh, np.empty((len(fresh), 0), np.int64)) if len(fresh) >= TOGETHER else [None] * len(fresh)
        for u, ready in zip(fresh, made, strict=True):
            self.node(u, made=ready)
        if long:
            empty = self.root[""] if "" in self.root else self.node("")
            at = np.array([self.root.get(u, empty) for u in units], np.int64)
        else:
            at = np.array(list(map(self.root.__getitem__, units)), np.int64)
        if dropout:
            due, turn = np.arange(len(units)), 0
            drawn = np.empty((len(units), 0), np.int64)  # the gaps of all turns so far
            while len(due):
                gaps = gaps_of(first[due], turn, dropout)
                more = gaps < np.frombuffer(self.rest, np.int32)[at[due]]
                due, gaps = due[more], gaps[more]
                drawn = np.concatenate((drawn[more], gaps[:, None]), axis=1)
                keys = (at[due] << 8 | gaps).tolist()
                found = list(map(self.branch.get, keys))
                if None in found:
                    new = {key: k for k, (key, node) in enumerate(zip(keys, found, strict=True)) if node is None}
                    which = list(new.values())
                    made = self.together([units[u] for u in due[which].tolist()], drawn[which]) if len(new) >= TOGETHER else [None] * len(new)
                    for (key, k), ready in zip(new.items(), made, strict=True):
                        self.node(units[due[k]], key >> 8, key & 255, ready)
                    found = list(map(self.branch.__getitem__, keys))
                at[due] = found
                turn += 1
        out = list(map(self.ids.__getitem__, at.tolist()))
        if long:
            for k, u in enumerate(units):
                if u in long:
                    drawn = (int(gaps_of(first[k : k + 1], turn, dropout)[0]) for turn in range(len(u) ** 2)) if dropout else ()
                    out[k] = self.ids_of(self.segment(u, drawn)[0])
        return out

    def encode_texts(self, texts: list[str], seed: int = 0, keys=0, dropout: float = 0.0) -> list[bytes]:
        """The ids of each text; keys: the documents' ids, or one for all texts."""
        from itertools import chain

        keys = keys if isinstance(keys, list) else [keys] * len(texts)
        lists = [_UNITS.findall(MARK + text.replace(MARK, _STANDIN).replace(" ", MARK)) if text else [] for text in texts]
        first = first_draws([(seed, key) for key in keys], [len(x) for x in lists]) if dropout else None
        found, at, out = self.encode_units(list(chain.from_iterable(lists)), first, dropout), 0, []
        for units in lists:
            out.append(b"".join(found[at : at + len(units)]))
            at += len(units)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; what is no UTF-8 is replaced. The mark put in front is taken away."""
        from array import array

        numbers = array("I")
        numbers.frombytes(ids)
        raw = b"".join(map(self.out.__getitem__, numbers)).decode("utf-8", "replace")
        return raw.removeprefix(" ")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def mixed(x):
    """Splitmix64's finisher on an array of unsigned longs."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15


def first_draws(keys: list[tuple], sizes: list[int]):
    """64 bits for each of sizes[i] units of the text with keys[i] = (seed, document id), by the unit's place."""
    import numpy as np
    import xxhash

    starts = np.array([xxhash.xxh3_64_intdigest(f"{seed}|{key}") for seed, key in keys], np.uint64)
    many = np.array(sizes, np.int64)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return mixed(np.repeat(starts, many) + (place + 1).astype(np.uint64) * np.uint64(_STEP))


def gaps_of(first, turn: int, dropout: float):
    """How many candidates are kept before the next is skipped, for the turn-th skip of each unit: P(gap >= k) = (1 - dropout)^k."""
    import numpy as np

    bits = first if turn == 0 else mixed(first + np.uint64(turn * _STEP % 2**64))
    uniform = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    with np.errstate(divide="ignore"):
        return np.minimum(np.log(uniform) / np.log1p(-dropout), 2.0**31 - 1).astype(np.int64)


def _encode_rows(path: str, dropout: float, seed: int):
    def run(batches):
        import pyarrow as pa

        from .packing import grouped

        take_over("sentencepiece", codec.cache_clear)
        own = codec(path)
        for batch in batches:
            for rows in grouped(batch, 500_000):
                ids = own.encode_texts([t for _, t in rows], seed, [k for k, _ in rows], dropout)
                keys = pa.array([k for k, _ in rows], batch.column(0).type)
                yield pa.record_batch([keys, pa.array(ids, pa.binary()), pa.array([own.decode(x) == t for x, (_, t) in zip(ids, rows, strict=True)])], names=["doc_id", "ids", "lossless"])

    return run


def encode(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids binary, lossless) of every row of docs(doc_id, text); lossless: the ids decode to the text.

    dropout 0 gives the model's own segmentation. Null and empty texts have no ids. Repeated rows are encoded each (the
    same way, as they share the id); other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(_encode_rows(model_path, dropout, seed), "doc_id long, ids binary, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids); null ids give an empty text."""

    def run(batches):
        import pyarrow as pa

        own = codec(model_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.decode(x.as_py() or b"") for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece(spark, sf_dir):
    """Every document encoded with merge dropout, and whether it decodes to its text."""
    import public_tokenizers

    from .common import documents

    rows = encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "lossless")
