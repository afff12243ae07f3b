"""Packing of token sequences into fixed windows: bounded-space best fit in each partition, leftovers merged as a tree.

Each partition keeps at most `open_windows` open windows. A document goes to the open window that it fills best; where
none has room, the fullest window is emitted, topped up by a cut when it would need more than `max_gap` padding. Full
windows are cut straight from longer documents. At the end of a partition its open windows are poured together, so one
partly filled window at most is left; these are merged `fan_in` partitions at a time until one is left.

Pieces carry their token ids and are written once to the shared folder, so nothing is tokenized twice. A task holds
`open_windows` windows and one output batch.
"""

from __future__ import annotations

import functools
import os
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordCache, take_over

WINDOW, OPEN_WINDOWS, MAX_GAP, FAN_IN, END_ID = 4096, 64, 16, 64, 2
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, leftover boolean, part long"
FIELDS = [f.split()[0] for f in PIECE.split(", ")]


def stem_of(word: str) -> tuple[str, str]:
    """(stem, tail) so that a lower-casing word tokenizer gives the stem's ids and then the tail's: tail is '', ',' or '.'.

    Only for letters and one mark behind them, where the cut is a token's border: not behind a letter whose lower case
    ends in a combining mark (\u0130), which a following comma or stop joins. Case is folded where it is plain.
    """
    tail = word[-1:]
    if tail in (",", ".") and word[:-1].isalpha() and word[-2].lower().isalpha():
        stem = word[:-1]
    elif word.isalpha():
        stem, tail = word, ""
    else:
        return word, ""
    return (stem.lower() if max(stem) < "\u0130" else stem), tail


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, limit: int = 600_000):
    """texts -> little-endian unsigned 32-bit ids of each, by a lower-casing tokenizer file whose pieces never hold white space.

    Such a tokenizer treats the runs between spaces and line ends apart, so each distinct run is encoded once and kept
    in a bounded cache; runs that differ in case or a last comma or stop share their stem's ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from array import array

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    width = array("I").itemsize
    if width != 4 or array("I", [1]).tobytes()[0] != 1:
        raise RuntimeError("ids are written as this machine's 32-bit integers, which must be little-endian")
    encode = lambda words: [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    tails = dict(zip(["", ",", "."], encode(["", ",", "."]), strict=True))
    ends = frozenset(i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>"))

    def encode_stems(stems: list[str]) -> list[bytes]:
        """Runs of letters are one word each, which ends at its only word-end piece: they are encoded as one text."""
        letters = [w for w in stems if w.isalpha()]
        ids = tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids if letters else []
        data, stops = array("I", ids).tobytes(), [4 * i + 4 for i, x in enumerate(ids) if x in ends]
        if len(stops) != len(letters):
            return encode(stems)
        found = dict(zip(letters, (data[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        others = [w for w in stems if w not in found]
        found.update(zip(others, encode(others), strict=True))
        return [found[w] for w in stems]

    def of_new(words: list[str]) -> list[bytes]:
        cut = [stem_of(w) for w in words]
        unknown = {stem for stem, _ in cut}.difference(kept.young)
        known = {stem: kept.old[stem] for stem in unknown if stem in kept.old}
        unknown = list(unknown.difference(known))
        known.update(zip(unknown, encode_stems(unknown), strict=True))
        kept.young.update((stem, ids) for stem, ids in known.items() if len(stem) <= kept.max_chars)
        return [(known[stem] if stem in known else kept.young[stem]) + tails[tail] for stem, tail in cut]

    kept = WordCache(of_new, limit)

    def encode_texts(texts: list[str]) -> list[bytes]:
        runs = [text.replace("\n", " ").split(" ") for text in texts]
        found, at, out = kept(list(chain.from_iterable(runs))), 0, []
        for own in runs:
            out.append(b"".join(found[at : at + len(own)]))
            at += len(own)
        return out

    return encode_texts


def grouped(batch, most_chars: int = 100_000):
    """Lists of (id, text) of an Arrow batch (id, text) with about most_chars characters each; a null text is ''."""
    rows, held = [], 0
    for key, text in zip(batch.column(0), batch.column(1), strict=True):
        text = text.as_py() or ""
        rows.append((key.as_py(), text))
        held += len(text)
        if held >= most_chars:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


class Packer:
    """One partition's windows. Emitted pieces: [doc_id, start, ids, doc_tokens, sequence, offset, leftover]."""

    def __init__(self, window: int, open_windows: int, max_gap: int):
        self.window, self.most, self.gap = window, open_windows, max_gap
        self.open: list[list] = []  # [room, pieces]
        self.out: list[tuple] = []
        self.sequences = 0

    def emit(self, pieces: list[tuple], leftover: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, ids, total, self.sequences, at, leftover))
            at += len(ids) // 4
        self.sequences += 1

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        whole = 4 * self.window
        while len(ids) >= whole:
            self.emit([(doc_id, start, ids[:whole], total)])
            start, ids = start + self.window, ids[whole:]
        while ids:
            need = len(ids) // 4
            fits = [w for w in self.open if w[0] >= need]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [self.window, []]
                self.open.append(best)
            else:
                fullest = min(self.open, key=lambda w: w[0])
                self.open.remove(fullest)
                if fullest[0] > self.gap:
                    cut = 4 * fullest[0]
                    fullest[1].append((doc_id, start, ids[:cut], total))
                    start, ids = start + fullest[0], ids[cut:]
                self.emit(fullest[1])
                continue
            best[1].append((doc_id, start, ids, total))
            best[0] -= need
            if best[0] == 0:
                self.open.remove(best)
                self.emit(best[1])
            return

    def finish(self, last: bool = False) -> None:
        """Pour the open windows together, fullest first; what doesn't fill a window is the leftover, or emitted if last."""
        now, room = [], self.window
        for _, pieces in sorted(self.open, key=lambda w: w[0]):
            for doc_id, start, ids, total in pieces:
                while ids:
                    part = ids[: 4 * room]
                    now.append((doc_id, start, part, total))
                    room -= len(part) // 4
                    start, ids = start + len(part) // 4, ids[len(part) :]
                    if room == 0:
                        self.emit(now)
                        now, room = [], self.window
        self.open = []
        if now:
            self.emit(now, leftover=not last)

    def batch(self, part: int, level: int):
        import pyarrow as pa

        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) or [()] * 7
        base = (level << 56) + (part << 24)
        return pa.record_batch(
            [
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([len(x) // 4 for x in cols[2]], pa.int64()), pa.array(cols[2], pa.binary()),
                pa.array(cols[3], pa.int64()), pa.array([base + s for s in cols[4]], pa.int64()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.bool_()), pa.array([part] * len(rows), pa.int64()),
            ],
            names=FIELDS,
        )


def _pack_partition(path: str, end_id: int, settings: tuple, batch_tokens: int = 500_000):
    def run(batches):
        from pyspark import TaskContext

        take_over("packing", word_encoder.cache_clear)
        encode = word_encoder(path)
        part, packer, end = TaskContext.get().partitionId(), Packer(*settings), end_id.to_bytes(4, "little")
        held = 0
        for batch in batches:
            for rows in grouped(batch):
                for (doc_id, _), ids in zip(rows, encode([text for _, text in rows]), strict=True):
                    ids += end
                    packer.add(doc_id, 0, ids, len(ids) // 4)
                    held += len(ids) // 4
                if held > batch_tokens:
                    yield packer.batch(part, 0)
                    held = 0
        packer.finish()
        yield packer.batch(part, 0)

    return run


def _merge_group(settings: tuple, level: int, last: bool, fan_in: int):
    def run(table):
        import pyarrow as pa

        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer, group = Packer(*settings), table.column("part")[0].as_py() // fan_in
        cols = [table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        packer.open = [[0, list(zip(*cols, strict=True))]]
        packer.finish(last)
        return pa.Table.from_batches([packer.batch(group, level)])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_gap: int = MAX_GAP, end_id: int = END_ID, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces (doc_id, start, length, ids binary, doc_tokens, sequence_id, offset) of all rows of docs(doc_id, text).

    A document is its text's ids and then end_id; each id is in exactly one piece and offsets have no gaps. A null or
    empty text is end_id alone; repeated rows are packed each; no rows give no rows. Other columns are ignored.
    """
    from .common import materialize

    settings = (window, open_windows, max_gap)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = materialize(plain.mapInArrow(_pack_partition(tokenizer_path, end_id, settings), PIECE), "pieces")
    done, left, level = pieces.where("not leftover"), pieces.where("leftover"), 1
    groups = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // fan_in)
        merged = left.groupBy(F.floor(F.col("part") / fan_in).alias("_group")).applyInArrow(_merge_group(settings, level, groups == 1, fan_in), PIECE)
        merged = merged if groups == 1 else materialize(merged, "leftovers")
        done = done.unionByName(merged.where("not leftover"))
        if groups == 1:
            return done.drop("leftover", "part")
        left, level = merged.where("leftover"), level + 1


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    from .common import documents

    return digests(pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
