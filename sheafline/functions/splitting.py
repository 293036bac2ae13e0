"""Splitting one text into overlapping chunks: the per-row helper of the chunk operator."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

# Separators from coarse to fine; the last one means single characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that concatenate to ``text``; a separator stays in front of the piece it opens."""
    if separator == "":
        return list(text)
    head, *rest = text.split(separator)
    return [piece for piece in (head, *(separator + tail for tail in rest)) if piece]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``; each chunk starts with up to ``overlap`` characters
    of whole pieces from the end of the one before."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that fits.

    A stretch without any of the separators stays whole, so only a list ending in ``""`` bounds
    every chunk.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[level + 1 :]
    chunks: list[str] = []
    run: list[str] = []

    def close_run() -> None:
        chunks.extend(c for c in (packed.strip() for packed in _pack(run, size, overlap)) if c)
        run.clear()

    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            run.append(piece)
            continue
        close_run()
        if finer:
            chunks.extend(split_text(piece, size, overlap, finer))
        elif piece.strip():
            chunks.append(piece)
    close_run()
    return chunks
