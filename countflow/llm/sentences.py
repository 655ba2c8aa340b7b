"""Problem 9: sentence boundaries in any language and script.

A linear-chain model tags every character as boundary (a unit ends with it) or inside,
and Viterbi decoding picks the best sequence of tags of a whole text. The features of a
character are taken from its surroundings: the kinds of the characters around it, the
words before and after, the line it stands in and the quotations that are open. Characters
between two letters or figures of a word share one feature. All weights are learned
(sentence_training.py) from made texts, whose units carry no marks in scripts that do
without them; no rule overrides the model. Features are sums over hashed codes and are
computed for many texts at once; nothing looks back or ahead a limited distance.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from countflow.functions.common import table

WEIGHTS = Path(__file__).with_name("sentence_weights.npz")

#: Kinds of characters.
(OTHER, END, BLANK, BREAK, UPPER, LOWER, LETTER, CJK, THAI, DIGIT, STOP, ASK, CRY, DOTS, FINAL, SEMI, COMMA, OPEN, CLOSE, STRAIGHT, APOS, DASH, BULLET, SYMBOL) = range(24)
_WORD = np.isin(np.arange(24), (UPPER, LOWER, LETTER, CJK, THAI, DIGIT))
_GAP = np.isin(np.arange(24), (BLANK, BREAK))
_MARK = np.isin(np.arange(24), (STOP, ASK, CRY, DOTS, FINAL, SEMI))
_QUOTE = np.isin(np.arange(24), (CLOSE, STRAIGHT, APOS))
_LEAD = np.isin(np.arange(24), (OPEN, STRAIGHT, APOS, DASH, BULLET))
#: Stands between texts; no character of Unicode.
_BETWEEN = "\U0010ffff"
BITS = 20
#: Code points that are analysed together (a longer text alone).
BATCH_CHARS = 400_000


@functools.cache
def kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, lower case and script of every code point, by Unicode properties."""
    kind, lower, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    ends = {ord(c) for c in regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x12000)])))}
    for c in [*range(0xD800), *range(0xE000, 0x12000), *range(0x1B000, 0x1B180), *range(0x1D000, 0x1F000)]:
        s = chr(c)
        g = unicodedata.category(s)
        if s.isspace():
            k = BREAK if s == "\n" else BLANK
        elif g[0] == "N":
            k = DIGIT
        elif g[0] in "LM" or c == 0x0E2F:
            name = unicodedata.name(s, "")
            wide = name.startswith(("CJK", "HIRAGANA", "KATAKANA"))
            k = CJK if wide else THAI if 0x0E00 <= c <= 0x0EFF else UPPER if g in ("Lu", "Lt") else LOWER if g == "Ll" else LETTER
            script[c] = sum(name.split(" ")[0].encode()) % 251 + 1
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif c in ends:
            k = STOP if s == "." else ASK if "QUESTION" in unicodedata.name(s, "") else CRY if "EXCLAMATION" in unicodedata.name(s, "") else FINAL
        else:
            k = OPEN if g in ("Ps", "Pi") else CLOSE if g in ("Pe", "Pf") else DASH if g == "Pd" else SYMBOL if g[0] == "S" else OTHER
        kind[c] = k
    for k, chars in {ASK: ";", SEMI: ";؛", DOTS: "…‥", COMMA: ",:،、，：", OPEN: "„‚「『¿¡", CLOSE: "”’」』", STRAIGHT: '"', APOS: "'", BULLET: "•*·|", SYMBOL: "@_/%&+=#"}.items():
        kind[[ord(c) for c in chars]] = k
    kind[0x4E00:0xA000] = kind[0x3400:0x4DC0] = kind[0x20000:0x30000] = CJK
    kind[ord(_BETWEEN)] = END
    return kind, lower, script


def _last(flag: np.ndarray) -> np.ndarray:
    """Place of the last flag at or before each place; 0 before the first."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag), dtype=np.int32), 0))


def _next(flag: np.ndarray) -> np.ndarray:
    """Place of the first flag at or after each place; the last place behind the last."""
    n = len(flag)
    return np.minimum.accumulate(np.where(flag, np.arange(n, dtype=np.int32), n - 1)[::-1])[::-1]


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _code(name: int, *parts) -> np.ndarray:
    """Hashed number of a feature with these values."""
    h = np.uint64(name * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019 & (1 << 64) - 1)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(64 - BITS) ^ h & np.uint64((1 << BITS) - 1)).astype(np.int32) & np.int32((1 << BITS) - 1)


def _size(n: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 2, 3, 4, 5, 7, 11, 20], n, "right").astype(np.uint64)


#: A line shorter than this is never taken for one that a fixed width has ended.
LEAST_WIDTH = 30


def widths(length: np.ndarray, need: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Which line breaks of one text a fixed width has forced, and how sure that is (0 to 2).

    length: of the lines that a non-blank line follows; need: length with the word that
    comes next; lengths: of all lines. A width w explains a break if length <= w < need.
    The width that explains most breaks is taken, of equal ones the largest; lines too
    long for it and long lines that it does not explain speak against it.
    """
    at = np.concatenate([length, need])
    by = np.concatenate([np.ones(len(length), np.int64), -np.ones(len(need), np.int64)])
    order = np.lexsort((by, at))
    at, votes = at[order], np.cumsum(by[order])
    k = votes[np.append(at[1:] != at[:-1], True)].max()
    if k < 1:
        return np.zeros(len(length), bool), 0
    at, votes = at[np.append(at[1:] != at[:-1], True)], votes[np.append(at[1:] != at[:-1], True)]
    i = np.flatnonzero(votes == k)[-1]
    width = at[i + 1] - 1 if i + 1 < len(at) else at[i]
    forced = (length <= width) & (width < need)
    against = int((length >= 0.66 * width).sum()) + 2 * int((lengths > width).sum())
    return forced, 0 if k < 0.5 * against else 2 if k >= 3 else 1


class View:
    """Many texts side by side: the loud places (where a unit may plausibly end) and their feature numbers."""

    def __init__(self, texts: list[str]) -> None:
        joined = _BETWEEN + _BETWEEN.join(texts) + _BETWEEN
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])[: len(texts)]
        self.sizes, self.n = sizes, len(cp)
        table_, low, script = kinds()
        k = table_[cp]
        self._quotes(k, cp)
        gap, word, end = _GAP[k], _WORD[k], k == END
        dots = (k == STOP) & ((np.roll(k, 1) == STOP) | (np.roll(k, -1) == STOP))
        k = np.where(dots, DOTS, k).astype(np.uint8)
        self.loud = ~gap & ~end
        self.loud[:-1] &= ~(word[:-1] & word[1:])
        self.inner = ~gap & ~end & ~self.loud
        p = self.places = np.flatnonzero(self.loud).astype(np.int32)
        self.features = self._features(cp, low[cp], script, k, gap, word, p, sizes)

    def _quotes(self, k: np.ndarray, cp: np.ndarray) -> None:
        """A high quote after a low one closes it."""
        high = cp == 0x201C
        if high.any():
            low = _last((cp == 0x201E) | (cp == 0x201A))
            other = _last(high | (cp == 0x201D))
            before = np.append(0, other[:-1])
            k[high & (low > before)] = CLOSE

    def _lines(self, cp: np.ndarray, k: np.ndarray, gap: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place: is it a line break forced by a width, and how sure is that in its text."""
        n = len(cp)
        forced, sure = np.zeros(n, bool), np.zeros(n, np.uint8)
        breaks = np.flatnonzero(k == BREAK)
        if not len(breaks):
            return forced, sure
        edge = np.flatnonzero((k == BREAK) | (k == END))
        length_of = np.diff(edge) - 1
        first = edge[:-1] + 1
        doc = np.searchsorted(self.starts, first, "right") - 1
        word_end = _next(gap | (k == END))
        follows = np.append((k[edge[1:-1]] == BREAK) & (length_of[1:] > 0), False)
        lead = np.minimum(first + length_of + 1, n - 1)
        need = length_of + 1 + np.where(np.isin(k[lead], (CJK, THAI)), 1, word_end[lead] - lead)
        use = follows & (length_of >= LEAST_WIDTH)
        for d in np.unique(doc[use]):
            a, b = np.searchsorted(doc, [d, d + 1])
            own = np.flatnonzero(use[a:b]) + a
            f, s = widths(length_of[own], need[own], length_of[a:b])
            forced[edge[own[f] + 1]] = s > 0
            sure[self.starts[d] : self.starts[d] + sizes[d]] = s
        return forced, sure

    def _features(self, cp, low, script, k, gap, word, p, sizes) -> np.ndarray:
        n = len(cp)
        zero = np.uint64(0)
        end = k == END
        solid = _next(~gap)
        solid_before = _last(~gap)
        newlines = np.cumsum(k == BREAK, dtype=np.int32)
        forced, sure = self._lines(cp, k, gap, sizes)
        hard = _last(((k == BREAK) & ~forced) | end)
        # Closing quotes, also behind a blank where the mark demands one.
        angle = (cp == 0xBB) | (cp == 0x203A)
        closing = _QUOTE[k]
        closing[:-1] |= gap[:-1] & angle[1:] & (k[:-1] != BREAK)
        core = _last(~closing)[p]
        mark_start = _last(~_MARK[k])
        token = _last(gap | end)
        lead = _next(~_LEAD[k])
        stop = _next(~word)
        token_stop = _next(gap | end)
        dots = np.cumsum(k == STOP, dtype=np.int32)
        digits = np.where(k == DIGIT, np.uint32(48), low).astype(np.uint64)
        up, down = _powers(1 << int(n).bit_length())
        sums = np.append(zero, np.cumsum((digits + np.uint64(7)) * up[:n], dtype=np.uint64))

        def words(a, b):
            return np.where(b > a, (sums[np.maximum(a, b)] - sums[a]) * down[a], zero)

        c, nxt1 = k[p].astype(np.uint64), k[np.minimum(p + 1, n - 1)].astype(np.uint64)
        m = k[core].astype(np.uint64)
        q = (core < p).astype(np.uint64)
        nn = solid[np.minimum(p + 1, n - 1)]
        broken = newlines[nn] - newlines[p]
        soft = np.zeros(len(p), bool)
        one = broken == 1
        break_at = _next(k == BREAK)[p]
        soft[one] = forced[break_at[one]]
        doc_sure = sure[p].astype(np.uint64)
        g = np.where(k[nn] == END, 6, np.where(broken > 1, 5, np.where(one, np.where(soft, 2 + doc_sure, 2), np.where(nn > p + 1, 1, 0)))).astype(np.uint64)
        inline = np.where(np.isin(g, (3, 4)), 1, np.minimum(g, 2))
        no = lead[nn]
        nk, nk2, opened = k[nn].astype(np.uint64), k[no].astype(np.uint64), (no > nn).astype(np.uint64)
        lo = self._lower_case(k, sizes)[np.searchsorted(self.starts, p, "right") - 1].astype(np.uint64)

        is_mark = _MARK[k[core]]
        b = np.where(is_mark, mark_start[core] + 1, core + 1)
        ts = token[core] + 1
        a = np.minimum(lead[np.minimum(ts, n - 1)], b)
        size = b - a
        ws = _size(size)
        cjk = np.isin(k[np.maximum(b - 1, 0)], (CJK, THAI))
        w = np.where(size > 12, np.uint64(1) + ws, words(a, b))
        w = np.where(cjk, np.uint64(2) + cp[np.maximum(b - 1, 0)], w)
        first = k[np.minimum(a, n - 1)].astype(np.uint64)
        hasdot = np.minimum(dots[np.maximum(b - 1, 0)] - dots[np.maximum(a - 1, 0)], 2).astype(np.uint64)
        lastk = k[np.maximum(b - 1, 0)].astype(np.uint64)
        shape = ((ws * np.uint64(32) + first) * np.uint64(4) + hasdot) * np.uint64(32) + lastk
        # The word before that word.
        pe = solid_before[np.maximum(ts - 1, 0)]
        head = (newlines[pe] != newlines[core]) | end[pe]
        soft_head = head & ~end[pe] & (forced[_next(k == BREAK)[pe]])
        pa_ = token[pe] + 1
        pw = np.where(head & ~soft_head, np.uint64(3), np.where(pe + 1 - pa_ > 10, np.uint64(4), words(pa_, pe + 1)))
        pk = np.where(head & ~soft_head, np.uint64(40), k[pe].astype(np.uint64) * np.uint64(32) + k[np.minimum(lead[np.minimum(pa_, n - 1)], n - 1)])
        # The word after.
        ne = np.maximum(stop[no], no)
        nsize = ne - no
        wide = np.isin(k[no], (CJK, THAI))
        nw = np.where(wide, np.uint64(5) + cp[no], np.where(nsize > 9, np.uint64(6), words(no, ne)))
        nshape = (np.minimum(_size(nsize), 6).astype(np.uint64) * np.uint64(32) + nk2) * np.uint64(32) + k[np.minimum(ne, n - 1)]
        # Quotations open here.
        wide_q = np.where((k == OPEN) & (cp != ord("(")) & (cp != ord("[")), 1, 0)
        opens, closes = _last(wide_q == 1), _last((k == CLOSE) & (cp != ord(")")) & (cp != ord("]")))
        block = hard[p]
        inside = ((opens[p] > closes[p]) & (opens[p] > block)).astype(np.uint64)
        straight = np.cumsum(k == STRAIGHT, dtype=np.int32)
        odd = ((straight[p] - straight[block]) & 1).astype(np.uint64)
        state = inside * np.uint64(2) + odd
        # The line and its neighbours.
        edge = (k == BREAK) | end
        line_start = _last(edge)[p] + 1
        line_end = _next(edge)[p]
        line_len = np.minimum((line_end - line_start) // 12, 8).astype(np.uint64)
        apart = np.zeros(n, bool)
        apart[1:-1] = (gap[:-2] & gap[2:] & ((cp[1:-1] == 0xB7) | (cp[1:-1] == 0x7C) | (cp[1:-1] == 0xBB) | (cp[1:-1] == 0x2022))) | (cp[1:-1] == 9)
        seps = np.cumsum(apart, dtype=np.int32)
        menu = np.minimum(seps[line_end] - seps[line_start - 1], 2).astype(np.uint64)
        after_end = _next(edge)[np.minimum(nn, n - 1)]
        after_last = k[solid_before[np.maximum(after_end - 1, 0)]]
        after_menu = np.minimum(seps[after_end] - seps[np.maximum(nn - 1, 0)], 2).astype(np.uint64)
        headline = ((after_end - nn < 45) & ~_MARK[after_last] & ~_QUOTE[after_last]).astype(np.uint64)
        after_len = np.minimum((after_end - nn) // 16, 5).astype(np.uint64)
        listed = self._entry(k, nn, stop, n)
        own_list = self._entry(k, np.minimum(line_start, n - 1), stop, n)
        in_list = np.where((b <= ts + 3) & (ts == line_start), 1, 0).astype(np.uint64)
        # The stretch since the last mark or break, in words; runs of scripts without blanks.
        spaces = np.cumsum(gap, dtype=np.int32)
        loud_mark = _last((_MARK[k] & (np.append(gap[1:], True) | closing | (k == FINAL))) | edge)
        since = loud_mark[np.maximum(mark_start[core], 0)]
        stretch = np.minimum(spaces[core] - spaces[since], 5).astype(np.uint64)
        before = _size(b - a)
        ahead = _size(token_stop[nn] - nn)
        # What stands before the next mark: words of reporting, in scripts without blanks.
        next_mark = _next(_MARK[k] | (k == COMMA) | edge)[nn]
        verb = np.where(np.isin(k[next_mark - 1], (CJK, THAI)), cp[next_mark - 1].astype(np.uint64), k[next_mark - 1].astype(np.uint64))
        verb_far = np.minimum((next_mark - nn) // 6, 4).astype(np.uint64)
        sa = np.where(script[cp[np.maximum(b - 1, 0)]] > 0, script[cp[np.maximum(b - 1, 0)]], 0).astype(np.uint64)
        quiet_end = np.where(is_mark, 0, 1).astype(np.uint64)
        this, that = cp[p].astype(np.uint64), cp[np.minimum(p + 1, n - 1)].astype(np.uint64)
        some = np.where(np.isin(k[p], (CJK, THAI)), np.uint64(1), np.where(word[p], np.uint64(0), this))
        other = np.where(word[np.minimum(p + 1, n - 1)], np.uint64(0), that)
        dense = np.where(np.isin(k[core], (CJK, THAI)) | np.isin(k[nn], (CJK, THAI)), np.uint64(1), zero)
        rep_here, rep_next = (this == 0x0E46).astype(np.uint64), (cp[nn] == 0x0E46).astype(np.uint64)
        return np.stack([
            _code(1, m, q, nxt1), _code(2, m, q, g), _code(3, m, q, inline, nk, opened, lo), _code(4, m, q, inline, nk2, opened),
            _code(5, m, w), _code(6, m, w, nk2, lo), _code(7, m, shape), _code(8, m, shape, nk2, lo), _code(9, m, q, inline, nw, opened),
            _code(10, m, shape, pk, nk2), _code(11, m, np.where(ws < 2, w, shape), pw), _code(12, m, in_list, own_list, first, inline), _code(13, m, q, state, c, inline), _code(14, some, other),
            _code(15, m, sa, inline), _code(16, g, quiet_end, nk, listed), _code(17, g, quiet_end, menu, after_menu), _code(18, g, m, headline, after_len, nk2), _code(19, m, shape, stretch, nk2),
            _code(20, dense, lastk, nk, g, rep_here, rep_next, m), _code(21, dense, before, ahead, inline, lastk, quiet_end), _code(22, m, w, nw), _code(23, m, q, nshape, ws), _code(24, g, quiet_end, line_len, own_list, lo),
            _code(25, m, pw, w, nk2), _code(26, m, q, state, nw), _code(27, menu, in_list, dense, quiet_end, inline), _code(28, m, c, q, inline, nk2, state), _code(29, m, q, dense, inline, verb, verb_far), _code(30, m, q, dense, state, verb, k[next_mark]),
        ])

    def _lower_case(self, k: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per text: letters with cases prevail, and none is a capital."""
        if not len(sizes):
            return np.zeros(0, bool)
        sums = np.append(0, np.cumsum(k == UPPER, dtype=np.int64)), np.append(0, np.cumsum(k == LOWER, dtype=np.int64)), np.append(0, np.cumsum(_WORD[k] & (k != DIGIT), dtype=np.int64))
        upper, lower, letters = (s[self.starts + sizes] - s[self.starts] for s in sums)
        return (upper == 0) & (lower * 2 > letters)

    @staticmethod
    def _entry(k: np.ndarray, at: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
        """Whether a list mark stands at a place: 1 dash or bullet, 2 figure with a point or bracket, 3 letter with one."""
        close = k[np.minimum(stop[at], n - 1)]
        ends = ((close == STOP) | (close == CLOSE)) & (k[np.minimum(stop[at] + 1, n - 1)] == BLANK)
        blank = k[np.minimum(at + 1, n - 1)] == BLANK
        return np.where(np.isin(k[at], (DASH, BULLET)) & blank, 1, np.where(ends & (k[at] == DIGIT), 2, np.where(ends & (stop[at] == at + 1), 3, 0))).astype(np.uint64)


class Model:
    """Weights of the chain: hashed features for `boundary` against `inside`, and the four transitions."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, inner: float) -> None:
        self.weights, self.transitions, self.inner = weights, transitions, inner

    def scores(self, view: View) -> np.ndarray:
        """Score of `boundary` at every place; a text's ends and blanks are inside by definition of a unit."""
        s = np.full(view.n, -1e9)
        s[view.inner] = self.inner
        s[view.places] = self.weights[view.features].sum(0)
        return s

    def decode(self, s: np.ndarray) -> np.ndarray:
        """Viterbi over all characters: places of the boundaries; the text is taken to follow a boundary.

        A place whose score lies below all that transitions could give back is inside in
        every best path, so the recursion runs over the other places only, with the
        transitions of the places between them added: the result is that of the full one.
        """
        (ii, ib), (bi, bb) = self.transitions
        gain = max(ii, ib, bi, bb) - min(ii, ib, bi, bb)
        open_ = np.flatnonzero(s > -2 * gain - 1e-9)
        back: list[tuple[bool, bool]] = []
        inside, edge, at = -1e18, 0.0, -1
        for i, score in zip(open_.tolist(), s[open_].tolist()):
            a, b = inside + ii, edge + bi
            if i > at + 1:
                # The places between are inside; both tags here have the same best way back.
                v = max(a, b) + (i - at - 2) * ii
                back.append((b > a, b > a))
                inside, edge = v + ii, v + ib + score
            else:
                c, d = inside + ib, edge + bb
                back.append((b > a, d > c))
                inside, edge = max(a, b), max(c, d) + score
            at = i
        tags = np.zeros(len(open_), bool)
        now = edge + bi > inside + ii if at + 1 < len(s) else edge > inside
        for k in range(len(open_) - 1, -1, -1):
            tags[k] = now
            now = back[k][1] if now else back[k][0]
        return open_[tags]


@functools.cache
def model() -> Model:
    with np.load(WEIGHTS) as f:
        weights = np.zeros(1 << BITS, np.float32)
        weights[f["number"]] = f["weight"]
        return Model(weights, f["transitions"].tolist(), float(f["inner"]))


# --- texts decoded with a wrong charset --------------------------------------------------------

_GARBLED = regex.compile("[Â-ß][\x80-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™�]|[à-ï][\x80-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™�]{2}")
_UNDEFINED = (0x9D, 0x81, 0x8D, 0x8F, 0x90)


def _bytes(s: str) -> bytes | None:
    """The bytes of s in cp1252, with its undefined places as they are; '�' gives None there (0)."""
    out = bytearray()
    for c in s:
        if c == "�":
            out.append(0)
            continue
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return None
            out.append(ord(c))
    return bytes(out)


@functools.lru_cache(maxsize=50_000)
def _restore(s: str) -> str | None:
    raw = _bytes(s)
    if raw is None:
        return None
    for fill in _UNDEFINED if 0 in raw else (0,):
        try:
            c = raw.replace(b"\0", bytes([fill])).decode("utf-8")
        except UnicodeDecodeError:
            continue
        # A blank must stay what it was, or trimming would lose characters of the text.
        if len(c) == 1 and not c.isspace():
            return c
    return None


def repaired(text: str) -> tuple[str, np.ndarray | None]:
    """text with characters restored that were decoded with a wrong charset, and the place of each in text."""
    if "Â" not in text and "Ã" not in text and "â" not in text and "à" not in text and "ã" not in text and "Ð" not in text and "Î" not in text and "Ø" not in text:
        return text, None
    out: list[str] = []
    places: list[int] = []
    at = hits = 0
    for m in _GARBLED.finditer(text):
        c = _restore(m.group())
        if c is None:
            continue
        hits += 1
        out.append(text[at : m.start()])
        out.append(c)
        places.append(m.start())
        at = m.end()
    if not hits:
        return text, None
    out.append(text[at:])
    fixed = "".join(out)
    # Positions: every kept stretch runs in step; a restored character stands for two or three.
    place = np.empty(len(fixed) + 1, np.int64)
    i = j = 0
    for k, start in enumerate(places):
        n = len(out[2 * k])
        place[i : i + n] = np.arange(j, j + n)
        i += n
        place[i] = start
        i += 1
        j = start + _length(text, start)
    n = len(fixed) - i
    place[i : i + n + 1] = np.arange(j, j + n + 1)
    return fixed, place


def _length(text: str, at: int) -> int:
    return 3 if "à" <= text[at] <= "ï" else 2


def many_units(texts: list[str | None], tagger: Model | None = None) -> list[list[tuple[int, int]]]:
    """Start and end (code points, end exclusive, blanks trimmed) of every sentence unit of every text.

    Null, empty and blank texts have no units. The units cover every other character. Time
    and memory grow in step with the length; nothing is cut off.
    """
    tagger = tagger or model()
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    some = [i for i, t in enumerate(texts) if t and not t.isspace()]
    at = 0
    while at < len(some):
        upto, chars = at, 0
        while upto < len(some) and (upto == at or chars + len(texts[some[upto]]) <= BATCH_CHARS):
            chars += len(texts[some[upto]])
            upto += 1
        part = [repaired(texts[i]) for i in some[at:upto]]
        view = View([t for t, _ in part])
        ends = tagger.decode(tagger.scores(view))
        cuts = np.searchsorted(ends, [[s, s + n] for s, n in zip(view.starts, view.sizes)])
        for i, (fixed, place), start, (a, b) in zip(some[at:upto], part, view.starts, cuts):
            out[i] = _spans(fixed, place, [*(ends[a:b] - start + 1).tolist(), len(fixed)])
        at = upto
    return out


def _spans(text: str, place: np.ndarray | None, ends: list[int]) -> list[tuple[int, int]]:
    out, start = [], 0
    for end in ends:
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b) if place is None else (int(place[a]), int(place[b])))
        start = max(start, end)
    return out


def units(text: str | None, tagger: Model | None = None) -> list[tuple[int, int]]:
    """The units of one text."""
    return many_units([text], tagger)[0]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tagger = model()
    schema = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])
    for batch in batches:
        found = many_units(batch.column("text").to_pylist(), tagger)
        ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found])))
        flat = np.array([x for own in found for x in own], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(flat[:, 0]), pa.array(flat[:, 1])], schema=schema)


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence unit of documents (doc_id, text).

    A map over rows without shuffle; rows with null text give nothing, repeated rows give
    their units again.
    """
    return documents.select("doc_id", "text").mapInArrow(_split, "doc_id long, start_char long, end_char long")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))
