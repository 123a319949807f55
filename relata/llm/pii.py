"""Personal data: fixed patterns, and spans added by a character-level bidirectional LSTM with a CRF.

The patterns give the base spans (email, ip, card, phone). The tagger reads every text in overlapping
windows of characters: an LSTM in each direction, emissions for five tags (none and the four kinds),
and transition scores between tags. Where windows overlap, each character takes its emissions from the
window in whose middle it lies; then one Viterbi path over the whole text, as if blanks lay around
it, reconciles all windows. Parts that hold no tag by proof are left out of the search; the others are
searched in blocks whose best scores between all pairs of border tags are joined along the text, so a
text of any length is decoded in bounded memory. An added span must hold what its kind needs (four
parts up to 255, a Luhn number, 9 to 15 digits, a name with host and domain), and must not touch a
base span.

The tagger is trained in numpy from labelled spans that training_texts makes by rule: usual and
disguised forms ("jo at host dot com", "10[.]0[.]0[.]9", "4111.1111...", "555-0100"). Its parameters
are kept beside this module; `python -m relata.llm.pii` trains them again and writes that file.

Defined results: a null text counts as empty and has no spans; places are code points, end exclusive;
repeated rows get equal answers; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN = 320, 256, 8
#: Fixed value: what a mail address may have at most, spelled out or not; longer runs of a tag are none.
LONGEST = 320
#: Emissions where there is no text.
NOTHING = np.array([0.0] + [-1e4] * len(KINDS), dtype=np.float32)
PARAMETERS = ("x", "u", "out", "bias", "move")
MARGIN = (WINDOW - STRIDE) // 2
#: The unit of the search: a stride is four cells, a margin half of one.
CELL = 2 * MARGIN
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
FORMAT = [("doc_id", None), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]

# --- base spans -----------------------------------------------------------------------------------

#: Characters of an email's name; the domain after '@'; the other kinds. Possessive
#: forms match the same leftmost spans as plain ones and never go back over a long run.
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in NAME:
            start -= 1
        end = None
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = free = m.end()
            yield start, end
        at = text.find("@", end or at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


_HAS_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in the order of KINDS."""
    digits = _HAS_DIGIT.search(text)
    return [list(_emails(text)) if "@" in text else [], list(_ips(text)) if digits else [], list(_cards(text)) if digits else [], list(_phones(text)) if digits and "+" in text else []]


# --- labelled training texts ----------------------------------------------------------------------


def training_texts(n: int, seed: int, length: int = 96) -> tuple[list[str], list[list[int]]]:
    """Texts of `length` characters and their tags, made by rule: prose, harmless numbers, personal data."""
    r = random.Random(seed)
    syllables = "an ba ci do el fu gé hi in jo ka lü mo ne os pa qu ré si tu un vö wa xi yo ze th er ou st ng tion ment keit heit ción".split()
    plain_letters = str.maketrans("éüöó", "euoo")
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pair = lambda: r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(("", "", "l", "n", "r", "s", "x"))
    plain = lambda: "".join(r.choice(syllables) if r.random() < 0.4 else pair() for _ in range(r.randint(1, 5))).translate(plain_letters)
    word = lambda: "".join(r.choice(syllables) if own else pair() for own in [r.random() < 0.5] for _ in range(r.randint(1, 4)))
    octets = lambda: [str(r.randint(0, 255)) for _ in range(4)]

    def card() -> str:
        body = str(r.randint(3, 6)) + digit(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email() -> str:
        name, host, end = plain() + r.choice(("", "." + plain(), digit(2))), plain() + r.choice(("", digit(1))), r.choice(("com", "org", "net", "de", "example.com"))
        at, dot = r.choice((" at ", " AT ", "[at]", "(at)", " [at] ", " (at) ")), r.choice((" dot ", " DOT ", "[dot]", "(dot)", " [dot] ", "."))
        spelled = f"{name.replace('.', dot) if r.random() < 0.3 else name}{at}{host}{r.choice(('', '', dot + plain()))}{dot}{end.replace('.', dot)}"
        return r.choice((f"{name}@{host}.{end}", spelled, spelled, f"{name}@{host} dot {end}"))

    def ip() -> str:
        return r.choice((".", ".", "[.]", " . ", "(.)")).join(octets())

    def number() -> str:
        c = card()
        return r.choice(("", " ", "-", ".", "/", "  ")).join((c[:4], c[4:8], c[8:12], c[12:]))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return r.choice((f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)}{a}{b}{c}", f"00{r.randint(1, 9)} {a} {b} {c}", f"{a}.{b}.{c}"))

    def harmless() -> str:
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 32, 40))))
        return r.choice((hexes, f'token = "{hexes}"', digit(r.randint(1, 6)), f"{r.randint(1900, 2030)}-{digit(2)}-{digit(2)}", f"{r.randint(0, 9)}.{r.randint(0, 20)}", f"{digit(1)}.{digit(1)}.{digit(2)}", "at the", "dot", f"{word()} at {word()}", f"dot {word()}", f"at {word()}", word() + r.choice("!?%$#&*") * 3, "| " + word() + " |", f"{digit(2)}:{digit(2)}:{digit(2)}", f"CC BY {digit(1)}.{digit(1)}", f"# {digit(3)}", digit(24), f"f({digit(1)}, {digit(2)})"))

    makers = (email, ip, number, phone)
    texts, tags = [], []
    for _ in range(n):
        text, tag = "", []
        while len(text) < length:
            u = r.random()
            if u < 0.16:
                kind = r.randrange(4)
                part, label = makers[kind](), kind + 1
            else:
                part, label = harmless() if u < 0.3 else word(), 0
            if r.random() < 0.1:
                part = part.capitalize() if label == 0 else part
            text += part
            tag += [label] * len(part)
            gap = r.choice((" ", " ", " ", " ", ". ", ", ", ".\n", "\n", " | ", "*** "))
            text += gap
            tag += [0] * len(gap)
        cut = r.randint(0, len(text) - length)
        texts.append(text[cut : cut + length])
        tags.append(tag[cut : cut + length])
    return texts, tags


# --- the tagger -----------------------------------------------------------------------------------

#: Characters are seen as themselves in ASCII, else as a lower or upper letter or another character.
CLASSES = 132


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, 130, dtype=np.uint8)
    table[:128] = np.arange(128)
    for c in range(128, 0x3000):
        if chr(c).isalpha():
            table[c] = 128 + chr(c).isupper()
    table[0x3000:0xFB00] = 128
    return table


def classes_of(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


class Tagger:
    """x (2, CLASSES, 4H), u (2, H, 4H) for both directions; out (2, H, K), bias (K), move (K, K).

    Gates are ordered in, forget, out, cell; those of the first three are stored at half scale, as
    sigmoid(2z) = (1 + tanh z) / 2, so one tanh serves all four.
    """

    K = len(KINDS) + 1

    def __init__(self, seed: int = 1, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.x = r.normal(0, 0.3, (2, CLASSES, 4 * hidden)).astype(np.float32)
        self.x[:, :, hidden : 2 * hidden] += 0.5
        self.u = r.normal(0, 0.3, (2, hidden, 4 * hidden)).astype(np.float32)
        self.out = r.normal(0, 0.3, (2, hidden, self.K)).astype(np.float32)
        self.bias = np.zeros(self.K, dtype=np.float32)
        self.move = np.zeros((self.K, self.K), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out, self.bias, self.move]

    def emissions(self, c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(T, B, K) scores of windows c (B, T), of which so many characters count; none is sure beyond them.

        Each gate of both directions lies in one piece (4, 2, B, H), so that the arithmetic runs over long
        rows; the hidden state is kept at twice its value, which u and out make good.
        """
        b, t = c.shape
        shortest = int(lengths.min())
        n = self.h
        codes = np.empty((t, 2, b), dtype=np.intp)
        codes[:, 0] = c.T
        np.add(codes[::-1, 0], CLASSES, out=codes[:, 1])
        x = np.ascontiguousarray(self.x.reshape(2, CLASSES, 4, n).transpose(2, 0, 1, 3)).reshape(4, 2 * CLASSES, n)
        u = np.ascontiguousarray(self.u.reshape(2, n, 4, n).transpose(2, 0, 1, 3)) * np.float32(0.5)
        out = self.out * np.float32(0.5)
        bias = np.tile(self.bias, (b, 1))
        h, s, g = (np.zeros((2, b, n), dtype=np.float32) for _ in range(3))
        z, w = np.empty((4, 2, b, n), dtype=np.float32), np.empty((4, 2, b, n), dtype=np.float32)
        e, more = np.empty((t, b, self.K), dtype=np.float32), np.empty((b, self.K), dtype=np.float32)
        for i in range(t):
            for gate in range(4):
                x[gate].take(codes[i], axis=0, out=w[gate], mode="clip")
            if t - i >= shortest:  # the way back starts at the window's last character
                beyond = lengths <= t - i
                h[1, beyond] = 0
                s[1, beyond] = 0
            np.matmul(h, u, out=z)
            z += w
            np.tanh(z, out=z)
            z[:3] += 1
            s *= z[1]
            np.multiply(z[0], z[3], out=g)
            s += g
            s *= 0.5
            np.tanh(s, out=h)
            h *= z[2]
            for way, at, is_new in ((0, i, 2 * i < t), (1, t - 1 - i, 2 * i < t - 1)):
                np.matmul(h[way], out[way], out=e[at] if is_new else more)
                if not is_new:
                    e[at] += more
                    e[at] += bias
        beyond = np.arange(shortest, t)[:, None] >= lengths
        e[shortest:][beyond] = NOTHING
        return e

    def hot(self, e: np.ndarray) -> np.ndarray:
        """Which cells (T, B, K) may pay for a run of tags, by an upper bound.

        A run of other tags gains at most its best emissions over none, and for each step the best
        transition over none's; it pays for entering and leaving in the cells where it does. The sums of
        best parts of runs are carried along the cell. A run that gains has a cell where its part does, so it
        touches a hot cell. A cell that a run may cover from border to border is hot too; in any other,
        the best path has a none, as two more borders would cost less. So the best path is found in hot
        cells and their neighbours, with none around them.
        """
        rest = self.move[0, 0]
        stay, into, out = float(self.move[1:, 1:].max() - rest), self.move[0, 1:] - rest, self.move[1:, 0] - rest
        enter, leave = float(into.max()), float(out.max())
        best = e[:, :, 1]
        for k in range(2, self.K):
            best = np.maximum(best, e[:, :, k])
        gain = best - e[:, :, 0]
        gain += np.float32(stay)
        ending, total = gain[0].copy(), gain[0].copy()  # the best part that ends here; all up to here
        inside, first = ending.copy(), total.copy()
        for now in gain[1:]:
            np.maximum(ending, 0, out=ending)
            ending += now
            np.maximum(inside, ending, out=inside)
            total += now
            np.maximum(first, total, out=first)
        whole = total + np.float32(stay - min(0.0, float(into.min()) + float(out.min())))
        return np.maximum.reduce([inside + (enter + leave - stay), first + leave, ending + (enter - stay), whole]) >= -1e-2

    def paths(self, e: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Best scores of blocks (T, B, K) from the first tags before them to each tag at the end, (B, before, K), and their back pointers (T, before, K, B)."""
        t, b, k = e.shape
        e = np.ascontiguousarray(e.transpose(0, 2, 1))
        back = np.zeros((t, before, k, b), dtype=np.int8)
        best = self.move[:before, :, None] + e[0][None]
        top, path = np.empty_like(best), np.empty_like(best)
        better, which = np.empty(best.shape, dtype=bool), np.empty(best.shape, dtype=np.int8)
        for i in range(1, t):
            np.add(best[:, :1], self.move[0][None, :, None], out=top)
            for j in range(1, k):
                np.add(best[:, j : j + 1], self.move[j][None, :, None], out=path)
                np.greater(path, top, out=better)
                np.multiply(better.view(np.int8), np.int8(j), out=which)
                np.maximum(back[i], which, out=back[i])  # the last j that was better
                np.maximum(top, path, out=top)
            np.add(top, e[i][None], out=best)
        return best.transpose(2, 0, 1), back

    def decode(self, blocks: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Viterbi tags (T, B) of blocks (T, B, K). follows: which blocks go on from the one before them; other runs lie between blanks."""
        t, n, k = blocks.shape
        # a block that begins a run comes after none, others after any tag
        groups = [(np.flatnonzero(~follows), 1), (np.flatnonzero(follows), k)]
        found = [self.paths(blocks[:, rows], m) if len(rows) else None for rows, m in groups]
        place = np.where(follows, np.cumsum(follows), np.cumsum(~follows)) - 1
        came, best = np.zeros((n, k), dtype=np.int8), np.zeros((n, k), dtype=np.float32)
        # the first block of every run, then the second of those that have one, and so on
        starts = np.flatnonzero(~follows)
        sizes = np.diff(starts, append=n)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        having = np.searchsorted(-sizes, -np.arange(sizes[0]))
        best[starts] = found[0][0][place[starts], 0]
        for i in range(1, len(having)):
            at = starts[: having[i]] + i
            path = best[at - 1][:, :, None] + found[1][0][place[at]]
            came[at], best[at] = path.argmax(axis=1), path.max(axis=1)
        before, own = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        ends = starts + sizes - 1
        own[ends] = (best[ends] + self.move[:, 0]).argmax(axis=1)
        for i in range(len(having) - 1, 0, -1):
            at = starts[: having[i]] + i
            own[at - 1] = before[at] = came[at, own[at]]
        tags = np.zeros((t, n), dtype=np.int8)
        for (rows, _), got in zip(groups, found, strict=True):
            if got is None:
                continue
            now, first, at = own[rows], before[rows], np.arange(len(rows))
            for i in range(t - 1, -1, -1):
                tags[i, rows] = now
                now = got[1][i, first, now, at]
        return tags

    def tag(self, texts: list[str], block: int = 1024) -> Iterator[np.ndarray]:
        """Tags of each text's characters.

        A text is cut into cells: the MARGIN characters that only its first window centres, CELL characters
        each of every window's STRIDE, and the last window's end. Hot cells and their neighbours are kept,
        filled up to CELL.
        """
        codes = [classes_of(t) for t in texts]
        counts = [max(1, -(-(len(c) - WINDOW) // STRIDE) + 1) if len(c) else 0 for c in codes]
        windows = ((i, j, n, c[STRIDE * j : STRIDE * j + WINDOW]) for i, (c, n) in enumerate(zip(codes, counts, strict=True)) for j in range(n))
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # texts, starts, emissions (cells, CELL, K)
        behind = (-1, 0, NOTHING, False, False)  # the cell before: text, start, emissions, whether it is hot, whether it is kept
        while part := list(islice(windows, block)):
            packed = np.full((len(part), WINDOW), 32, dtype=np.uint8)
            for r, (_, _, _, c) in enumerate(part):
                packed[r, : len(c)] = c
            e = self.emissions(packed, np.array([len(x[3]) for x in part]))
            marks = np.array([x[:3] for x in part])
            hot = np.stack([self.hot(e[max(0, low) : low + CELL]) for low in range(-MARGIN, WINDOW, CELL)], axis=1)
            there = np.ones(hot.shape, dtype=bool)
            there[:, 0], there[:, -1] = marks[:, 1] == 0, marks[:, 1] == marks[:, 2] - 1
            row, slot = np.nonzero(there)
            text, start, hot = marks[row, 0], STRIDE * marks[row, 1] + CELL * slot - MARGIN, hot[there]
            beside = text[1:] == text[:-1]
            keep = hot.copy()
            keep[1:] |= beside & hot[:-1]
            keep[:-1] |= beside & hot[1:]
            if behind[0] == text[0]:
                keep[0] |= behind[3]
                if hot[0] and not behind[4]:
                    kept.append((text[:1], np.array([behind[1]]), behind[2][None]))
            chosen = np.flatnonzero(keep)
            cells = np.empty((len(chosen) + 1, CELL, self.K), dtype=np.float32)  # the last cell, too, for the next block
            cells[:] = NOTHING
            for own, at in enumerate([*chosen.tolist(), len(keep) - 1]):
                low = CELL * int(slot[at]) - MARGIN
                skip = max(0, -low)
                values = e[low + skip : low + CELL, row[at]]
                cells[own, skip : skip + len(values)] = values
            kept.append((text[chosen], start[chosen], cells[:-1]))
            behind = (int(text[-1]), int(start[-1]), cells[-1].copy(), bool(hot[-1]), bool(keep[-1]))
        tags = [np.zeros(len(c), dtype=np.int8) for c in codes]
        if any(len(x[0]) for x in kept):
            text, start = (np.concatenate([x[i] for x in kept]) for i in range(2))
            full = np.concatenate([x[2] for x in kept]).transpose(1, 0, 2)
            follows = np.concatenate(([False], (text[1:] == text[:-1]) & (start[1:] == start[:-1] + CELL)))
            # runs of cells are decoded together, some at a time
            starts = [*np.flatnonzero(~follows).tolist(), len(text)]
            a = 0
            for b, c in zip(starts[1:], [*starts[2:], None], strict=True):
                if c is None or c - a > 4 * block:
                    for i, at, own in zip(text[a:b].tolist(), start[a:b].tolist(), self.decode(full[:, a:b], follows[a:b]).T, strict=True):
                        low, high = max(0, at), min(len(tags[i]), at + CELL)
                        if low < high:
                            tags[i][low:high] = own[low - at : high - at]
                    a = b
        yield from tags

    # --- training ---

    def loss_and_gradients(self, c: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        b, t = c.shape
        n, k = self.h, self.K
        order = [np.ascontiguousarray(c.T), np.ascontiguousarray(c.T[::-1])]
        gates = np.empty((t, 2, b, 4 * n), dtype=np.float32)
        cells, hiddens = np.zeros((t + 1, 2, b, n), dtype=np.float32), np.zeros((t + 1, 2, b, n), dtype=np.float32)
        for i in range(t):
            z = np.matmul(hiddens[i], self.u)
            z[0] += self.x[0][order[0][i]]
            z[1] += self.x[1][order[1][i]]
            g = np.tanh(z)
            g[:, :, : 3 * n] = (g[:, :, : 3 * n] + 1) / 2
            cells[i + 1] = g[:, :, n : 2 * n] * cells[i] + g[:, :, :n] * g[:, :, 3 * n :]
            hiddens[i + 1] = g[:, :, 2 * n : 3 * n] * np.tanh(cells[i + 1])
            gates[i] = g
        e = hiddens[1:, 0] @ self.out[0] + (hiddens[1:, 1] @ self.out[1])[::-1] + self.bias
        # CRF: forward and backward sums
        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis=axis))

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for i in range(1, t):
            alpha[i] = lse(alpha[i - 1][:, :, None] + self.move, 1) + e[i]
        for i in range(t - 2, -1, -1):
            beta[i] = lse(self.move + (beta[i + 1] + e[i + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        yt, rows = y.T, np.arange(b)
        gold = e[np.arange(t)[:, None], rows, yt].sum(axis=0) + self.move[yt[:-1], yt[1:]].sum(axis=0)
        de = np.exp(alpha + beta - total[:, None])
        de[np.arange(t)[:, None], rows, yt] -= 1
        de /= b
        both = np.exp(alpha[:-1, :, :, None] + self.move + (beta[1:] + e[1:])[:, :, None, :] - total[:, None, None])
        dmove = both.sum(axis=(0, 1))
        np.subtract.at(dmove, (yt[:-1].reshape(-1), yt[1:].reshape(-1)), 1)
        dmove /= b
        # back through the LSTMs
        dout = np.stack([np.einsum("tbh,tbk->hk", hiddens[1:, 0], de), np.einsum("tbh,tbk->hk", hiddens[1:, 1], de[::-1])])
        du, dx = np.zeros_like(self.u), np.zeros_like(self.x)
        dh, dc = np.zeros((2, b, n), dtype=np.float32), np.zeros((2, b, n), dtype=np.float32)
        zs = np.empty_like(gates)
        for i in range(t - 1, -1, -1):
            g, cell = gates[i], np.tanh(cells[i + 1])
            dh = dh + np.stack([de[i] @ self.out[0].T, de[t - 1 - i] @ self.out[1].T])
            dc = dc + dh * g[:, :, 2 * n : 3 * n] * (1 - cell * cell)
            dz = np.empty_like(g)
            dz[:, :, :n] = dc * g[:, :, 3 * n :]
            dz[:, :, n : 2 * n] = dc * cells[i]
            dz[:, :, 2 * n : 3 * n] = dh * cell
            dz[:, :, : 3 * n] *= 2 * g[:, :, : 3 * n] * (1 - g[:, :, : 3 * n])
            dz[:, :, 3 * n :] = dc * g[:, :, :n] * (1 - g[:, :, 3 * n :] ** 2)
            du += np.matmul(hiddens[i].transpose(0, 2, 1), dz)
            zs[i] = dz
            dh = np.matmul(dz, self.u.transpose(0, 2, 1))
            dc = dc * g[:, :, n : 2 * n]
        for d in range(2):
            np.add.at(dx[d], order[d].reshape(-1), zs[:, d].reshape(-1, 4 * n))
        return float((total - gold).mean()), [dx, du, dout, de.sum(axis=(0, 1)), dmove]


def fit(steps: int = 2000, batch: int = 64, length: int = 128, seed: int = 4, rate: float = 0.02) -> Tagger:
    """Adam on fresh batches of training_texts; the step falls to a tenth over the run."""
    tagger = Tagger(seed)
    first = [np.zeros_like(p) for p in tagger.parameters()]
    second = [np.zeros_like(p) for p in tagger.parameters()]
    for step in range(1, steps + 1):
        texts, tags = training_texts(batch, seed * 100_003 + step, length)
        _, grads = tagger.loss_and_gradients(np.stack([classes_of(t) for t in texts]), np.array(tags))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * (1 - 0.9 * step / steps)
        for p, g, a, b in zip(tagger.parameters(), grads, first, second, strict=True):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return tagger


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    """The tagger whose parameters are kept beside this module; trained now where the file is missing."""
    if not WEIGHTS.exists():
        return fit()
    tagger = Tagger()
    with np.load(WEIGHTS) as kept:
        tagger.x, tagger.u, tagger.out, tagger.bias, tagger.move = (kept[n] for n in PARAMETERS)
    return tagger


# --- spans ----------------------------------------------------------------------------------------

_AT_WORD, _DOT_WORD = re.compile(r"@|\bat\b|[\[(]at[\])]", re.I), re.compile(r"\.|\bdot\b", re.I)


#: The one word before an address's "at", which may be spelled with "dot".
_NAME = re.compile(r"[^\s@\[\]()]++(?:(?:\s++dot\s++|\s*+[\[(]dot[\])]\s*+)[^\s@\[\]()]++)*+\s*+$", re.I)


def _sound(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        parts = _AT_WORD.split(text)
        return len(parts) == 2 and bool(re.search(r"\w", parts[0])) and len([p for p in _DOT_WORD.split(parts[1]) if re.search(r"\w", p)]) >= 2
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 9 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", text)


def added_spans(text: str, tags: np.ndarray, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Runs of a tag that hold what their kind needs and touch no base span."""
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    if not tags.any():
        return out
    taken = sorted(s for spans in base for s in spans)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0])).astype(np.int16)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        kind = int(tags[a]) - 1
        if kind < 0:
            continue
        while a < b and not (text[a].isalnum() if kind == 0 else "0" <= text[a] <= "9" or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() if kind == 0 else "0" <= text[b - 1] <= "9"):
            b -= 1
        if b - a > LONGEST:
            continue
        if kind == 0 and (at := _AT_WORD.search(text, a, b)) and (name := _NAME.search(text, a, at.start())):
            a = name.start() + len(name[0]) - len(name[0].lstrip("."))
        # a number or word that goes on beyond the run is another thing
        if b > a and not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum()) and not any(s < b and a < e for s, e in taken) and _sound(kind, text[a:b]):
            out[kind].append((a, b))
    return out


def _listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=True) for a, b in sorted(own))


def find(docs: DataFrame, tagger: Tagger | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added. A map, no shuffle."""
    prepare(docs.sparkSession, 256)
    tagger = tagger or default_tagger()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for text, tags in zip(texts, tagger.tag(texts), strict=True):
                base = base_spans(text)
                added = added_spans(text, tags, base)
                rows.append((*map(len, base), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed([a + b for a, b in zip(base, added, strict=True)]), sum(map(len, added))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, FORMAT[1:], strict=True))], [n for n, _ in FORMAT])

    return slim.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


if __name__ == "__main__":
    np.savez(WEIGHTS, **dict(zip(PARAMETERS, fit().parameters(), strict=True)))
