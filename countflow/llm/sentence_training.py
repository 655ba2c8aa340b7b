"""Trains the weights of the sentence tagger: `python -m countflow.llm.sentence_training`.

Texts are put together from the phrases in phrases.py, with abbreviations, quotations,
numbers and so on, and set in many layouts (lines, blank lines, paragraphs, fixed width,
missing blanks, lower case), so that the place of every boundary is known. Units of
scripts that do without marks are also set without any. A penalised pseudo-likelihood fit
of the chain learns the weights of features and transitions.
"""

from __future__ import annotations

import random
import re
import textwrap
import zlib

import numpy as np

from countflow.llm.phrases import CASED, DENSE, PHRASES, UNMARKED
from countflow.llm.sentences import BITS, WEIGHTS, Model, View, many_units

#: Made texts of the fit (its documented bound), and steps of the descent.
TEXTS, STEPS = 16000, 120
#: Final marks that stand for one another (fixed values): full stops of scripts with marks of their own.
STOPS = "।。።។။۔॥｡"


def _lists(lang: str, part: str) -> dict[str, list[str]]:
    """The phrases of a language; part `fit` or `held` leaves out those of the other, told apart by a checksum."""
    out = {}
    for key, text in PHRASES[lang].items():
        items = re.split(r"(?<!\|)\|(?!\|)", text)
        if part != "all" and len(items) >= 4 and key not in ("quote", "notice", "if", "month"):
            held = [x for x in items if zlib.crc32(x.encode()) % 4 == 0]
            items = (held if part == "held" else [x for x in items if x not in held]) or items
        out[key] = items
    return out


class Maker:
    """Makes texts with known boundaries."""

    def __init__(self, r: random.Random, part: str = "all") -> None:
        self.r, self.part = r, part
        self.lists = {lang: _lists(lang, part) for lang in PHRASES}

    def pick(self, lang: str, key: str) -> str:
        return self.fill(self.r.choice(self.lists[lang][key]), lang)

    def fill(self, s: str, lang: str) -> str:
        r = self.r

        def one(m: re.Match) -> str:
            k = m.group(1)
            if k == "i":
                return str(r.randint(1, 99) if r.random() < 0.8 else r.randint(100, 9999))
            if k == "f":
                return f"{r.randint(0, 99)}{',' if lang in CASED and lang != 'en' and r.random() < 0.7 else '.'}{r.randint(0, 9)}"
            if k == "y":
                return str(r.randint(1950, 2040))
            if k == "A":
                return r.choice("ABCDEFGHIJKLMNOPRSTVWZ" if lang != "ru" else "АБВГДЕИКЛМНОПРСТ")
            return {"N": lambda: self.pick(lang, "name"), "T": lambda: self.pick(lang, "title"), "m": lambda: self.pick(lang, "month"), "s": lambda: self.pick(lang, "subject"), "p": lambda: self.pick(lang, "predicate"), "p2": lambda: self.pick(lang, "predicate").split(" ", 1)[-1], "s2": lambda: self.pick(lang, "subject")}[k]()

        return re.sub(r"\{(\w+)\}", one, s)

    def clause(self, lang: str, subject: str | None = None) -> str:
        r = self.r
        gap = "" if lang in DENSE else " "
        s, p = subject or self.pick(lang, "subject"), self.pick(lang, "predicate")
        t = self.pick(lang, "tail") if r.random() < 0.55 else ""
        if t and lang in CASED and r.random() < 0.25:
            verb, _, rest = p.partition(" ")
            return f"{t} {verb} {s} {rest}".strip() if lang == "de" else f"{t}{r.choice([',', ''])} {s} {p}"
        order = [p, s, t] if lang == "ar" else [s, t, p] if lang in ("zh", "hi") else [s + "は", t, p] if lang == "ja" else [s, p, t]
        return gap.join(x for x in order if x)

    @staticmethod
    def closed(s: str) -> str:
        """A point that ends an abbreviation ends the sentence too."""
        return s[:-1] if s.endswith("..") and not s.endswith("...") else s

    def mark(self, lang: str, kind: str) -> str:
        r = self.r
        if lang == "th":
            return ""
        if kind == "ask":
            m = {"el": r.choice(";;;;"), "ar": "؟", "zh": "？", "ja": "？"}.get(lang, "?")
        elif kind == "cry":
            m = {"zh": "！", "ja": "！"}.get(lang, "!")
        else:
            m = {"zh": "。", "ja": "。", "hi": "।"}.get(lang, ".")
            if m != "." and r.random() < 0.2 or r.random() < 0.04:
                m = r.choice(STOPS)
        if lang == "fr" and m in "?!":
            m = r.choice([" ", " ", " ", " "]) + m
        if m in "?!" and r.random() < 0.06:
            m += r.choice("?!")
        return m

    def up(self, s: str) -> str:
        return s[:1].upper() + s[1:]

    def plain(self, lang: str) -> str:
        """One sentence of the simplest kinds, with its final mark."""
        x = self.r.random()
        if x < 0.2:
            return ("¿" if lang == "es" else "") + self.pick(lang, "ask") + self.mark(lang, "ask")
        if x < 0.3:
            return ("¡" if lang == "es" else "") + self.pick(lang, "cry") + self.mark(lang, "cry")
        if x < 0.42:
            return self.pick(lang, "short") + self.mark(lang, "")
        return self.up(self.clause(lang)) + self.mark(lang, "")

    def sentences(self, lang: str) -> list[str]:
        """One or a few sentences that follow one another."""
        r, pick, up = self.r, self.pick, self.up
        gap = "" if lang in DENSE else " "
        end = self.mark(lang, "")
        kind = r.choice(["plain"] * 5 + ["title"] * 3 + ["number"] * 2 + ["inner", "last", "last", "measure", "measure", "omit", "quote", "quote", "quote", "wrote", "web", "paren", "if", "initials", "figure", "list", "colon", "nested"])
        if lang == "th":
            kind = r.choice(["plain"] * 5 + ["if"])
        if lang in ("zh", "ja") and kind in ("title", "inner", "last", "initials", "measure"):
            kind = "plain"
        if kind == "plain":
            return [self.plain(lang)]
        if kind == "title":
            name = f"{pick(lang, 'title')} {pick(lang, 'name')}"
            if r.random() < 0.3:
                name = f"{pick(lang, 'title')} {self.fill(r.choice(['{A}.', '{A}. {A}.', '{A}.']), lang)} {pick(lang, 'name')}"
            x = r.random()
            if x < 0.5:
                return [up(self.clause(lang, name)) + end]
            if x < 0.7:
                return [f"{up(self.clause(lang))}, {name} {pick(lang, 'tail')}{end}"]
            return [f"{up(pick(lang, 'subject'))} {pick(lang, 'predicate')}, {pick(lang, 'title')} {pick(lang, 'name')} {pick(lang, 'predicate')}{end}"]
        if kind == "number":
            n = f"{pick(lang, 'number')}{gap}{self.fill(r.choice(['{i}', '{i}', '{f}', '{i}.{i}']), lang)}"
            x = r.random()
            if x < 0.35:
                return [f"{up(self.clause(lang))} {n}{end}" if gap else f"{self.clause(lang)}{n}{end}"]
            if x < 0.6:
                return [f"{up(self.clause(lang))} ({n}){end}" if gap else f"{self.clause(lang)}（{n}）{end}"]
            if x < 0.8:
                return [f"{up(n)}{gap}{pick(lang, 'predicate')}{end}"]
            return [f"{up(pick(lang, 'subject'))}{gap}{pick(lang, 'predicate')}{gap}{n}{gap}{pick(lang, 'tail')}{end}"]
        if kind == "inner":
            x = r.choice([", ", " ", " ("])
            return [f"{up(self.clause(lang))}{x}{pick(lang, 'inner')} {r.choice([pick(lang, 'subject'), pick(lang, 'tail'), pick(lang, 'name')])}{')' if x == ' (' else ''}{end}"]
        if kind == "last":
            a = pick(lang, "last")
            x = r.random()
            if x < 0.45:
                return [f"{up(self.clause(lang))}, {pick(lang, 'subject')} {a}" + ("" if a.endswith(".") else end)]
            if x < 0.6:
                return [f"{up(self.clause(lang))}, {pick(lang, 'name')} {a}" + (r.choice([",", ""]) + f" {pick(lang, 'tail')}") + end]
            return [f"{up(pick(lang, 'subject'))}, {pick(lang, 'subject')} {a}{r.choice(['', '', ','])} {pick(lang, 'predicate')}{end}"]
        if kind == "measure" and lang == "ru" and r.random() < 0.4:
            who = self.fill(r.choice(["{A}. {A}. {N}", "{N}", "{s}", "{T} {N}"]), lang)
            return [f"{up(self.clause(lang))} {self.fill('в {y} г.', lang)}"] if r.random() < 0.5 else [self.fill("В {y} г. ", lang) + self.clause(lang, who) + end]
        if kind == "measure":
            a = self.fill("{i}" if r.random() < 0.7 else "{i}:{i}0", lang) + " " + pick(lang, "measure")
            x = r.random()
            if x < 0.4:
                return [f"{up(self.clause(lang))} {a}" + ("" if a.endswith(".") else end)]
            if x < 0.5 and gap:
                return [f"{up(self.clause(lang))} {a} ({self.clause(lang)}){end}"]
            if x < 0.6 and gap:
                return [f"{up(self.clause(lang))} {a}{r.choice([',', ''])} {pick(lang, 'then')}{end}"]
            if x < 0.8 and gap:
                prep = {"en": "at", "de": "um", "fr": "vers", "es": "a", "ru": "в", "el": "στις"}.get(lang, "")
                return [f"{up(prep + ' ' + a if prep else a)}{r.choice([',', ''])} {self.clause(lang)}{end}"]
            return [f"{up(pick(lang, 'subject'))}{gap}{pick(lang, 'predicate')}{gap or ' '}{a} {pick(lang, 'tail')}{end}"]
        if kind == "omit":
            d = r.choice(["...", "...", "…", "……"]) if lang not in ("zh", "ja") else r.choice(["……", "…"])
            a = self.up(r.choice([self.clause(lang), pick(lang, "cry"), pick(lang, "short")]))
            x = r.random()
            rest = pick(lang, "then") if x < 0.35 else self.clause(lang) if x < 0.75 or not gap else f"{pick(lang, 'title')} {pick(lang, 'name')} {pick(lang, 'predicate')}"
            return [f"{a}{d}{gap}{rest}{end}"]
        if kind in ("quote", "wrote", "nested"):
            left, right = (self.lists[lang]["quote"][r.randrange(len(self.lists[lang]["quote"]))] + " ").split(" ")[:2]
            if lang == "fr" and left == "«":
                left, right = r.choice([("« ", " »"), ("« ", " »"), ("« ", " »"), ("«", "»")])
            said = self.fill(r.choice(self.lists[lang]["said"]), lang)
            comma = {"zh": "，", "ja": "、", "ar": "،"}.get(lang, ",")
            if lang == "es" and left == "—":
                one = up(self.clause(lang))
                return [f"—{one} —{said}—."] if r.random() < 0.5 else [f"—{one} —{said}—.", self.plain(lang)]
            if kind == "wrote":
                more = [self.plain(lang) for _ in range(r.randint(1, 2))]
                lead = up(self.clause(lang)) + {"zh": "：", "ja": "："}.get(lang, ": ")
                more[0] = lead + left + more[0]
                more[-1] += right
                return more
            if kind == "nested":
                return [f"{up(self.clause(lang))}{comma}{gap}{left}{self.clause(lang)}{right}{end}"]
            many = [self.plain(lang) for _ in range(r.choice([0, 0, 1, 1, 2]))]
            x = r.random()
            body = up(self.clause(lang))
            if x < 0.4 and lang not in ("zh", "ja"):
                tail = f"{body}{right}{comma} {said}{end}" if r.random() < 0.6 and lang != "en" else f"{body}{comma}{right} {said}{end}"
            elif x < 0.75:
                tail = f"{r.choice([pick(lang, 'cry') + self.mark(lang, 'cry'), pick(lang, 'ask') + self.mark(lang, 'ask'), body + end if lang in ('zh', 'ja') else pick(lang, 'cry') + self.mark(lang, 'cry')])}{right}{gap}{said}{end}"
            elif x < 0.85 and gap:
                tail = f"{body}{comma}{right} {said}{comma} {left}{self.clause(lang)}{end}{right}" if end else f"{body}{right} {said}"
            else:
                tail = f"{self.plain(lang)}{right}"
            many.append(tail)
            many[0] = left + many[0]
            return many
        if kind == "web":
            return [pick(lang, "web") + end]
        if kind == "paren":
            a, b = ("（", "）") if lang in ("zh", "ja") else (" (", ")")
            if r.random() < 0.3 and gap:
                return [self.plain(lang), f"({up(self.clause(lang))}{end})"]
            return [f"{up(self.clause(lang))}{a}{r.choice([self.clause(lang), pick(lang, 'tail'), pick(lang, 'ask') + self.mark(lang, 'ask')])}{b}{end}"]
        if kind == "if":
            return [up(self.fill(r.choice(self.lists[lang]["if"]), lang)) + end]
        if kind == "initials":
            return [self.fill(r.choice(["{A}. {A}. ", "{A}. ", "{A}.{A}. "]), lang) + self.clause(lang, pick(lang, "name")) + end] if r.random() < 0.6 else [f"{up(self.clause(lang))} {self.fill(r.choice(['{N} {A}. {N}', '{A}. {A}. {N}', '{A}. {N}']), lang)}{end}"]
        if kind == "figure":
            f = self.fill(r.choice(["{i}", "{f}", "{y}", "{f}%", "{i}%", "{i}:{i}0", "{i}.{i}", "{f} %"]), lang)
            return [up(self.clause(lang)) + gap + f + end]
        comma = {"zh": "、", "ja": "、", "ar": "، "}.get(lang, ", ")
        if kind == "list":
            return [up(comma.join(pick(lang, "subject") for _ in range(r.randint(2, 4)))) + gap + pick(lang, "predicate") + end]
        if lang == "fr" and r.random() < 0.5:
            return [f"{up(self.clause(lang))}{r.choice(' \u00a0\u202f')}; {r.choice([self.clause(lang), self.clause(lang, pick(lang, 'title') + ' ' + pick(lang, 'name'))])}{end}"]
        colon = r.choice([{"zh": "；", "ja": "、", "ar": "؛ ", "el": "· "}.get(lang, "; "), {"zh": "：", "ja": "："}.get(lang, ": ")])
        return [up(self.clause(lang)) + colon + self.clause(lang) + end]

    def line(self, lang: str) -> list[str]:
        """The units of a line that is no running text."""
        r = self.r
        x = r.random()
        if x < 0.2:
            sep = r.choice([" · ", " | ", " » ", " • ", "\t", "  "])
            return [sep.join(self.pick(lang, "menu") for _ in range(r.randint(2, 8)))]
        if x < 0.3:
            return self.fill(r.choice(self.lists[lang]["notice"]), lang).split("||")
        if x < 0.5:
            return [self.pick(lang, "menu")]
        if x < 0.8:
            return [self.pick(lang, "line")]
        body = r.choice([self.pick(lang, "subject"), self.pick(lang, "line"), f"{self.pick(lang, 'number')} {self.fill('{i}', lang)}", self.clause(lang)])
        return [self.fill(r.choice(["- ", "• ", "* ", "{i}. ", "{i}. ", "{i}) ", "a) ", "b. "]), lang) + body]

    def text(self, lang: str) -> tuple[str, set[int]]:
        """A made text and the ends of its units."""
        r = self.r
        unmarked = lang in UNMARKED and lang != "th" and r.random() < 0.25
        lines: list[list[str]] = [self.line(lang if r.random() < 0.8 else "en") for _ in range(r.choice([0, 0, 1, 2, 3, 5]))]
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.3:
                lines += [self.line(lang) for _ in range(r.randint(1, 3))]
            part: list[str] = []
            for _ in range(r.randint(1, 5)):
                if unmarked:
                    part.append(self.clause(lang))
                else:
                    part += map(self.closed, self.sentences("en" if lang != "en" and r.random() < 0.05 else lang))
            lines.append(part)
        if r.random() < 0.4:
            lines.append(self.line(r.choice([lang, "en"])))
        tight = 0.06 if lang != "th" and not unmarked else 0.0
        width = r.choice([74, 66, 72, 80, 60, 90]) if r.random() < 0.3 else 0
        between = r.choice(["\n", "\n\n"])
        text, ends = "", set()
        for n, line in enumerate(lines):
            para, stops = "", []
            for u in line:
                if para:
                    close = lang in DENSE and not unmarked and lang != "th" or r.random() < tight and para[-1] in ".?!।؟\"”»" and (u[0].isupper() or u[0].isalpha() and not u[0].islower())
                    para += "" if close else " "
                para += u
                stops.append(len(para))
            if width and len(para) > width:
                para, stops = _wrapped(para, stops, width, lang in DENSE)
            text += between if n else ""
            ends |= {len(text) + x for x in stops}
            text += para
        if lang in CASED and r.random() < 0.12 and len(text.lower()) == len(text):
            text = text.lower()
        return text, ends


def _wrapped(para: str, stops: list[int], width: int, dense: bool) -> tuple[str, list[int]]:
    """The paragraph broken to a width, and its ends in the new text."""
    pieces = textwrap.wrap(para, width, break_on_hyphens=False, break_long_words=dense, expand_tabs=False, replace_whitespace=False)
    new, where, j = "", {}, 0
    for q, piece in enumerate(pieces):
        new += "\n" if q else ""
        for c in piece:
            while para[j] != c and not (c == " " and para[j].isspace()):
                j += 1
            where[j] = len(new)
            new += c
            j += 1
    return new, [where[x - 1] + 1 for x in stops]


def examples(n: int, seed: int, part: str = "all", leave_out: tuple[str, ...] = ()) -> list[tuple[str, set[int]]]:
    r = random.Random(seed)
    maker = Maker(r, part)
    langs = [x for x in PHRASES if x not in leave_out]
    return [maker.text("en" if k % 4 == 0 and "en" in langs else langs[k % len(langs)]) for k in range(n)]


def fit(made: list[tuple[str, set[int]]], steps: int = STEPS, penalty: float = 2e-6) -> Model:
    """Weights by penalised pseudo-likelihood: each tag given its neighbours, its features and the transitions."""
    blocks, tags, quiet = [], [], np.zeros((2, 2), np.int64)
    before, after = [], []
    for at in range(0, len(made), 500):
        part = made[at : at + 500]
        view = View([t for t, _ in part])
        y = np.zeros(view.n, np.int8)
        for start, (_, ends) in zip(view.starts, part):
            y[[start + e - 1 for e in ends]] = 1
        p = view.places
        blocks.append(view.features)
        tags.append(y[p])
        before.append(y[p - 1])
        after.append(y[p + 1])
        inner = np.flatnonzero(view.inner)
        np.add.at(quiet, (y[inner - 1], y[inner + 1]), 1)
    x, y = np.concatenate(blocks, 1), np.concatenate(tags).astype(np.float32)
    b, a = np.concatenate(before).astype(int), np.concatenate(after).astype(int)
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(-1, len(y)).astype(np.int32)
    w, t, c = np.zeros(len(used)), np.zeros((2, 2)), 0.0
    size = len(y)
    m = [np.zeros_like(w), np.zeros_like(t), 0.0]
    v = [np.zeros_like(w), np.zeros_like(t), 0.0]
    flat = x.ravel()
    for step in range(1, steps + 1):
        # The pull of the transitions towards `boundary` between neighbours (before, after).
        pull = t[:, 1][:, None] - t[:, 0][:, None] + t[1][None, :] - t[0][None, :]
        z = w[x].sum(0) + pull[b, a]
        e = 1 / (1 + np.exp(-z)) - y
        eq = quiet / (1 + np.exp(-(c + pull)))
        gp = np.zeros((2, 2))
        np.add.at(gp, (b, a), e)
        gp += eq
        gt = np.zeros((2, 2))
        gt[:, 1] += gp.sum(1)
        gt[:, 0] -= gp.sum(1)
        gt[1] += gp.sum(0)
        gt[0] -= gp.sum(0)
        g = [np.bincount(flat, weights=np.broadcast_to(e, x.shape).ravel(), minlength=len(w)) / size + penalty * w, gt / size + penalty * t, eq.sum() / size + penalty * c]
        for i, (gi, rate) in enumerate(zip(g, (0.1, 0.05, 0.2))):
            m[i] = 0.9 * m[i] + 0.1 * gi
            v[i] = 0.99 * v[i] + 0.01 * gi * gi
            d = rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
            if i == 0:
                w -= d
            elif i == 1:
                t = t - d
            else:
                c -= d
        if step % 20 == 0:
            print("step", step, "wrong", int(((e > 0.5) | (e < -0.5)).sum()), "of", size, flush=True)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = np.where(np.abs(w) > 0.02, w, 0)
    return Model(weights, t.tolist(), float(c))


def save(m: Model) -> None:
    number = np.flatnonzero(m.weights).astype(np.int32)
    np.savez_compressed(WEIGHTS, number=number, weight=m.weights[number].astype(np.float16), transitions=np.array(m.transitions), inner=m.inner)


def accuracy(m: Model, made: list[tuple[str, set[int]]]) -> tuple[float, float, list]:
    """Share of units found, share of found that are units, and the mistakes."""
    both = found = true = 0
    bad = []
    for (text, ends), own in zip(made, many_units([t for t, _ in made], m)):
        want, at = set(), 0
        for e in sorted(ends):
            s = at
            while s < e and text[s].isspace():
                s += 1
            want.add((s, e))
            at = e
        both += len(want & set(own))
        found += len(own)
        true += len(want)
        bad += [text[max(0, e - 30) : e] + "¶" + text[e : e + 20] + (" [missed]" if e in ends else " [made up]") for e in {e for _, e in want} ^ {e for _, e in own}]
    return both / max(1, true), both / max(1, found), bad


if __name__ == "__main__":
    held = fit(examples(TEXTS, 7, "fit"))
    print("phrases held out", accuracy(held, examples(1100, 99, "held"))[:2], flush=True)
    final = fit(examples(TEXTS, 7))
    save(final)
    found, right, mistakes = accuracy(final, examples(550, 98))
    print("all phrases", found, right)
    for line in mistakes[:40]:
        print(repr(line))
