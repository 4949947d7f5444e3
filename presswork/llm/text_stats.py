"""Statistics of a text for quality rules, in bounded blocks of the whole text."""

from __future__ import annotations

import numpy as np
import regex

from presswork.llm.common import decoded, word_blocks

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = regex.compile(r"\p{Lu}")
_MARKS = regex.compile(r"[^\p{L}\p{M}\p{N}\s]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LINES_AT_ONCE = 1 << 22


def _code_points(raw: bytes) -> int:
    at = np.frombuffer(raw, np.uint8)
    return int(np.count_nonzero((at & 0xC0) != 0x80))


def repeated_words(words: np.ndarray) -> int:
    """Words covered by runs of ``WINDOW`` words that occur twice or more in the text.

    ``words`` holds a 64-bit hash per word; runs are compared by 64-bit hashes of these.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    run = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        run = (run ^ (run >> np.uint64(29))) * _MIX + words[i : i + n]
    order = np.sort(run)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(run, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def _repeated_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    seen: set[int | bytes] = set()
    total = 0
    at = 0
    while at <= len(raw):
        end = len(raw)
        if end - at > _LINES_AT_ONCE:
            gap = raw.find(b"\n", at + _LINES_AT_ONCE)
            end = len(raw) if gap < 0 else gap
        own = [x for x in raw[at:end].split(b"\n") if x.strip(SPACES)]
        total += len(own)
        seen.update(own)
        at = end + 1
    return total, total - len(seen)


def text_stats(raw: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then n_lines,
    n_distinct (different words), n_upper (capital letters), n_marks (characters that are
    neither letters, digits nor white space)."""
    raw = raw or b""
    hashes = []
    for words in word_blocks(raw):
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    words = np.concatenate(hashes) if len(hashes) > 1 else hashes[0]
    text = decoded(raw)
    n_lines, n_dup_lines = _repeated_lines(raw)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return (
        len(words),
        _code_points(raw) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        n_dup_lines,
        repeated_words(words),
        n_lines,
        len(np.unique(words)),
        len(_UPPER.findall(text)),
        len(_MARKS.findall(text)),
    )
