"""A bounded per-process cache from words to what a codec makes of them, for use inside executors' Python workers."""

from __future__ import annotations


_holder: list = [None, None]


def take_over(name: str, clear) -> None:
    """Say that this worker process now serves operator `name`, whose caches `clear` empties.

    Workers are used again by later jobs: when another operator takes over, the caches of the one before are emptied,
    so that a process holds one operator's words at a time, and what they freed goes back to the system.
    """
    if _holder[0] not in (None, name):
        _holder[1]()
        give_back()
    _holder[:] = [name, clear]


def give_back() -> None:
    """Return this process's freed memory to the system, which the allocators would keep for later."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


class WordCache:
    """Two generations of at most `limit` words each: words seen again move to the young one, the old one is dropped.

    encode: list of words -> list of values of the same length. Words longer than max_chars are never kept.
    """

    def __init__(self, encode, limit: int = 250_000, max_chars: int = 200):
        self.encode, self.limit, self.max_chars, self.young, self.old = encode, limit, max_chars, {}, {}

    def __call__(self, words: list) -> list:
        young = self.young
        missing = set(words).difference(young)
        extra: dict = {}
        if missing:
            old, new = self.old, []
            for w in missing:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
            for w, v in zip(new, self.encode(new), strict=True):
                if len(w) <= self.max_chars:
                    young[w] = v
                else:
                    extra[w] = v
        out = [young[w] if w in young else extra[w] for w in words] if extra else list(map(young.__getitem__, words))
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out
