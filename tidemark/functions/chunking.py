"""Token-budgeted chunks with overlap (C1-C10). Merging is a fold over a text's pieces, so it runs in Python."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from .counting import PatternCounter, TokenCounter

FENCE = re.compile(r"^```[^\n]*\n[\s\S]*?^```[^\n]*$", re.M)
PARAGRAPH, SENTENCE = re.compile(r"\n{2,}"), re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Limits:
    embed: int = 8192
    target: int = 1024
    overlap: int = 128
    least: int = 64


@dataclass(frozen=True)
class Piece:
    text: str
    start: int
    end: int
    tokens: int


class Chunker:
    """chunks(text, content_type) gives (text, start, end, tokens) rows; there is always at least one.

    A text within limits.embed tokens is one chunk. A longer one is cut at paragraphs (code fences whole, too long
    paragraphs into sentences), lines or sentences, by content type, and the pieces are packed into chunks of up
    to limits.target tokens. Each chunk opens with the last whole pieces of the one before that fit in
    limits.overlap; a last chunk below limits.least is added to the one before. Pieces beyond the target are cut at
    words, with spans that count one blank between words.
    """

    def __init__(self, counter: TokenCounter | None = None, limits: Limits = Limits()):
        self.counter, self.limits = counter or PatternCounter(), limits

    def _cut(self, text: str, at: re.Pattern, offset: int = 0) -> Iterator[tuple[str, int]]:
        start = 0
        for m in at.finditer(text):
            if text[start : m.start()].strip():
                yield text[start : m.start()], offset + start
            start = m.end()
        if text[start:].strip():
            yield text[start:], offset + start

    def _markdown(self, text: str) -> Iterator[tuple[str, int]]:
        start = 0
        fences = [(m.start(), m.end()) for m in FENCE.finditer(text)]
        for low, high in [*fences, (len(text), len(text))]:
            for part, at in self._cut(text[start:low], PARAGRAPH, start):
                if self.counter.count(part) <= self.limits.target:
                    yield part, at
                else:
                    yield from self._cut(part, SENTENCE, at)
            if high > low:
                yield text[low:high], low
            start = high

    def pieces(self, text: str, content_type: str) -> Iterable[Piece]:
        if content_type in ("assistant_thinking", "assistant_response"):
            parts = self._markdown(text)
        elif content_type == "tool_output":
            parts = self._cut(text, re.compile("\n"))
        else:
            parts = self._cut(text, SENTENCE)
        for part, at in parts:
            yield Piece(part, at, at + len(part), self.counter.count(part))

    def _forced(self, piece: Piece) -> Iterator[tuple[str, int, int, int]]:
        words, at, first = piece.text.split(), piece.start, 0
        counts = list(itertools.accumulate(map(self.counter.count, words), initial=0)) if self.counter.additive else None
        while first < len(words):
            text = " ".join(words[first : (end := self._fitting(words, first, counts))])
            yield text, at, at + len(text), self.counter.count(text)
            at, first = at + len(text) + 1, end

    def _fitting(self, words: list[str], first: int, counts: list[int] | None) -> int:
        """The end of the longest run of words from first on that is within the target; one word at least."""
        if counts is not None:
            return max(first + 1, bisect.bisect_right(counts, counts[first] + self.limits.target) - 1)
        fits = lambda end: self.counter.count(" ".join(words[first:end])) <= self.limits.target
        low, step = first + 1, 1
        while low + step <= len(words) and fits(low + step):
            low, step = low + step, 2 * step
        high = min(low + step, len(words) + 1)  # low fits or is a single word, high doesn't
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        return low

    def _join(self, held: list[Piece]) -> tuple[str, int, int, int]:
        text = "\n\n".join(p.text for p in held)
        return text, held[0].start, held[-1].end, self.counter.count(text)

    def _tail(self, held: list[Piece]) -> list[Piece]:
        kept, room = len(held), self.limits.overlap
        while kept and held[kept - 1].tokens <= room:
            kept -= 1
            room -= held[kept].tokens
        return held[kept:]

    def chunks(self, text: str | None, content_type: str) -> list[tuple[str, int, int, int]]:
        text = text or ""
        total = self.counter.count(text)
        whole = [(text, 0, len(text), total)]
        if not text.strip() or total <= self.limits.embed:
            return whole
        out: list[tuple[str, int, int, int]] = []
        held: list[Piece] = []
        size = 0
        for piece in self.pieces(text, content_type):
            if piece.tokens > self.limits.target:
                out += [self._join(held)] if held else []
                out += self._forced(piece)
                held, size = [], 0
            elif held and size + piece.tokens > self.limits.target:
                out.append(self._join(held))
                held = [*self._tail(held), piece]
                size = sum(p.tokens for p in held)
            else:
                held.append(piece)
                size += piece.tokens
        if held and out and size < self.limits.least:
            last = out.pop()
            joined = "\n\n".join([last[0], *(p.text for p in held)])
            out.append((joined, last[1], held[-1].end, self.counter.count(joined)))
        elif held:
            out.append(self._join(held))
        return out or whole
