"""A bounded per-worker cache of tokenised text chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class ChunkCache:
    """Maps a chunk of text to the ids of its tokens, as little-endian 32-bit bytes.

    Tokenisers whose merges never cross a chunk border give the same ids chunk by chunk as
    for a whole text, and natural text repeats its words. Two generations of at most
    ``limit`` chunks each bound the memory; long chunks are never kept.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 250_000, longest: int = 64, split: Callable[[str], tuple[str, ...]] | None = None):
        self.encode, self.limit, self.longest, self.split = encode, limit, longest, split
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _cached(self, chunk: str) -> bytes | None:
        ids = self.young.get(chunk)
        if ids is None:
            ids = self.old.get(chunk)
            if ids is not None:
                self.young[chunk] = ids
        return ids

    def lookup(self, texts: Iterable[list[str]]) -> dict[str, bytes]:
        """A mapping that gives the ids of every chunk of ``texts`` (lists of chunks) until the next call.

        ``split`` may name the parts of a chunk whose ids follow one another; then the parts
        are tokenised, each once.
        """
        young = self.young
        passing = _Passing(young)
        missing, joined, parts = [], [], set()
        for chunk in set().union(*texts).difference(young):
            if self._cached(chunk) is not None:
                continue
            if self.split and len(own := self.split(chunk)) > 1:
                joined.append((chunk, own))
                parts.update(own)
            else:
                missing.append(chunk)
        missing += [part for part in parts.difference(missing) if self._cached(part) is None]
        if missing:
            for chunk, ids in zip(missing, self.encode(missing), strict=True):
                (young if len(chunk) <= self.longest else passing)[chunk] = ids
        for chunk, own in joined:
            (young if len(chunk) <= self.longest else passing)[chunk] = b"".join([passing[part] for part in own])
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return passing if passing else young


class _Passing(dict):
    """Ids of the chunks that are not kept; all others are looked up among those that are."""

    def __init__(self, kept: dict[str, bytes]):
        self.kept = kept

    def __missing__(self, chunk: str) -> bytes:
        return self.kept[chunk]


def slices(rows: Iterable, weigh: Callable, most: int = 4_000_000, at_most: int = 2000) -> Iterable[list]:
    """Runs of ``rows`` whose weights sum to about ``most``; a heavier row stands alone."""
    held, weight = [], 0
    for row in rows:
        w = weigh(row)
        if held and (weight + w > most or len(held) >= at_most):
            yield held
            held, weight = [], 0
        held.append(row)
        weight += w
    if held:
        yield held
