"""Cutting packed UTF-8 text into units that a tokenizer treats apart, without a loop over characters."""

from __future__ import annotations

import numpy as np

from . import vec

SPACE, LETTER, DIGIT, PUNCT, OTHER = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = SPACE
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
_CLASS[list(b"0123456789")] = DIGIT
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = PUNCT


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte; letters of the Latin-1 block count as letters, all else above ASCII and the apostrophe as OTHER."""
    cls = _CLASS[buf]
    lead = np.flatnonzero(buf == 0xC3)
    if len(lead):
        tail = buf[lead + 1]
        lead = lead[(tail != 0x97) & (tail != 0xB7)]
        cls[lead] = LETTER
        cls[lead + 1] = LETTER
    return cls


def odd_spaces(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold white space beyond ASCII, or ASCII separators that libraries class differently."""
    hit = []
    if (buf >= 0xC2).any():
        pad = np.concatenate((buf, np.zeros(2, np.uint8)))
        for lead, second, third in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
            at = np.flatnonzero(buf == lead)
            at = at[np.isin(pad[at + 1], second)]
            hit.append(at[np.isin(pad[at + 2], third)] if third else at)
    hit.append(np.flatnonzero((buf >= 0x1C) & (buf <= 0x1F)))
    return np.unique(vec.rows_of(np.concatenate(hit), off))


def cut(buf: np.ndarray, off: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, plain) of units in order.

    A run of one class is a plain unit.  A chunk between spaces that holds an OTHER byte stays whole and isn't plain.
    With `spaces`, a single blank before a unit belongs to it, and the rest of a run of spaces is one unit (all of it where
    the row ends); without, spaces are left out.  Rows with odd spaces are one unit each, not plain."""
    cls = classes(buf)
    start, end = vec.runs(cls, off)
    if not len(start):
        return start, end, np.zeros(0, bool)
    kind = cls[start]
    row_first = np.zeros(len(start), bool)
    lo = off[:-1][np.diff(off) > 0]
    row_first[np.searchsorted(start, lo)] = True
    space = kind == SPACE
    chunk = np.cumsum(space | row_first | np.concatenate(([False], space[:-1])))
    mixed = np.bincount(chunk, kind == OTHER)[chunk] > 0
    head = np.ones(len(start), bool)
    head[1:] = ~(mixed[1:] & (chunk[1:] == chunk[:-1]))
    at = np.flatnonzero(head)
    end = end[np.append(at[1:], len(start)) - 1]
    start, space, row_first, plain = start[at], space[at], row_first[at], ~mixed[at]
    if spaces:
        followed = space & ~np.append(row_first[1:], True)
        blank = followed & (buf[end - 1] == 32)
        rest = end - (followed & (end > start))
        start, end = start.copy(), end.copy()
        i = np.flatnonzero(blank)
        start[i + 1] = end[i] - 1
        single = np.flatnonzero(followed & ~blank)
        end[followed] = rest[followed]
        if len(single):
            start = np.concatenate((start, end[single]))
            plain = np.concatenate((plain, np.ones(len(single), bool)))
            end = np.concatenate((end, end[single] + 1))
            order = np.argsort(start, kind="stable")
            start, end, plain = start[order], end[order], plain[order]
        some = end > start
        start, end, plain = start[some], end[some], plain[some]
    else:
        start, end, plain = start[~space], end[~space], plain[~space]
    odd = odd_spaces(buf, off)
    if len(odd):
        keep = ~np.isin(vec.rows_of(start, off), odd)
        start = np.concatenate((start[keep], off[odd]))
        end = np.concatenate((end[keep], off[odd + 1]))
        plain = np.concatenate((plain[keep], np.zeros(len(odd), bool)))
        order = np.argsort(start, kind="stable")
        start, end, plain = start[order], end[order], plain[order]
    return start, end, plain
