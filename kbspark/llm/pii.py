"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Whole texts are cut into overlapping windows; each is decoded by itself, and every character takes the tag of the window in which it lies
farthest from an edge. The tagger learns the base patterns' spans and forms beyond them (see ``LOOSE_FORMS``): spelled-out or bracketed
addresses, cards in dots or slashes, and telephone numbers without a plus sign. A span that it adds must mean what its kind says
(``_valid``); texts in which no stretch at all could (``may_hold``) give it nothing to decide and aren't decoded.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never begins inside a run of digits, since it would have begun with the run; the look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind; matches that fail their check are dropped."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:  # a match has one @: take what may stand before it, then what must follow
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the model ---------------------------------------------------------------------------------------------------------------------

#: Tags: outside, then beginning and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)
#: An inside tag follows its own kind's tags only, and a beginning the outside.
_FORBIDDEN = np.zeros((N_TAGS, N_TAGS), np.float32)
for _k in range(2, N_TAGS, 2):
    _FORBIDDEN[:, _k] = -1e4
    _FORBIDDEN[_k - 1 : _k + 1, _k] = 0
    _FORBIDDEN[1:, _k - 1] = -1e4
_CLASSES = "@.+-()_%=\"' ,:;/\n#*&$|<>!?[]{}"


def classes(text: str) -> np.ndarray:
    """Each character's class: letters and digits by case and place, marks for themselves, the rest together."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return _CLASS[np.minimum(code, 1024)]


def _class_table() -> np.ndarray:
    table = np.full(1025, 1, np.int64)
    for i, c in enumerate(_CLASSES):
        table[ord(c)] = 2 + i
    base = 2 + len(_CLASSES)
    for i, c in enumerate("0123456789"):
        table[ord(c)] = base + i
    for i in range(26):
        table[97 + i], table[65 + i] = base + 10 + i, base + 36
    table[0xC0:0x250] = base + 37
    return table


_CLASS = _class_table()
N_CLASSES = int(_CLASS.max()) + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Parameters, as a dictionary of float32 arrays; ``hidden`` cells in each direction.

    The second direction reads the window from its end, so one loop runs both: arrays begin with the direction. Gates stand in the order
    in, forget, out, candidate.
    """

    hidden: int
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(hidden: int = 8, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"x": rng.normal(0, 0.3, (2, N_CLASSES, 4 * hidden)), "h": rng.normal(0, 0.2, (2, hidden, 4 * hidden)), "out": rng.normal(0, 0.2, (2 * hidden, N_TAGS)), "bias": np.zeros(N_TAGS), "step": np.zeros((N_TAGS, N_TAGS))}
        p["x"][:, :, hidden : 2 * hidden] += 1.0  # forget gates begin open
        return Tagger(hidden, {k: v.astype(np.float32) for k, v in p.items()})

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **self.p)
        return held.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tagger:
        p = dict(np.load(io.BytesIO(raw)))
        return Tagger(p["h"].shape[1], p)

    @property
    def step(self) -> np.ndarray:
        """Transition scores, from rows to columns."""
        return self.p["step"] + _FORBIDDEN

    def _run(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Hidden states [direction, step, window, hidden]; ``tape`` gets what the gradient needs of each step."""
        n, t = x.shape
        H = self.hidden
        # a sigmoid is half a hyperbolic tangent of half its argument and a half: one call makes all gates, and halves move into weights
        half = np.repeat(np.array([0.5, 1.0], np.float32), [3 * H, H])
        wx, wh = self.p["x"] * half, self.p["h"] * (0.5 * half)
        read = np.stack([x.T, x.T[::-1]])
        out = np.empty((2, t, n, H), np.float32)
        h, c = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)  # h is twice the state until the end
        z, r, a = np.empty((2, n, 4 * H), np.float32), np.empty((2, n, 4 * H), np.float32), np.empty((2, n, H), np.float32)
        for k in range(t):
            for d in (0, 1):
                np.take(wx[d], read[d, k], axis=0, out=z[d], mode="clip")
            np.matmul(h, wh, out=r)
            np.add(z, r, out=z)
            np.tanh(z, out=z)
            np.add(z, 1, out=r)  # twice the gates
            before = (h * np.float32(0.5), c.copy()) if tape is not None else None
            c *= r[:, :, H : 2 * H]
            np.multiply(r[:, :, :H], z[:, :, 3 * H :], out=a)
            c += a
            c *= 0.5
            np.tanh(c, out=a)
            h = np.multiply(r[:, :, 2 * H : 3 * H], a, out=out[:, k])
            if tape is not None:
                r *= 0.5
                r[:, :, 3 * H :] = z[:, :, 3 * H :]
                tape.append((r.copy(), a.copy(), *before))
        out *= 0.5
        return out

    def _emissions(self, out: np.ndarray) -> np.ndarray:
        H = self.hidden
        return out[0] @ self.p["out"][:H] + out[1, ::-1] @ self.p["out"][H:] + self.p["bias"]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emission scores [time, window, tag]; what stands before a window counts as outside."""
        e = self._emissions(self._run(x))
        e[0] += self.step[0]
        return e

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags [window, time] under the transitions.

        A path that leaves the outside is a row of spans with some of it between them. A window in which no span gains, wherever it begins
        and ends, needs no search.
        """
        return self.paths(self.scores(x))

    def paths(self, e: np.ndarray) -> np.ndarray:
        """``decode`` from scores."""
        step = self.step - self.step[0, 0]
        begin, inside = (np.ascontiguousarray((e[:, :, k::2] - e[:, :, :1]).transpose(0, 2, 1)) for k in (1, 2))  # [time, kind, window]
        begin[1:] += step[0, 1::2][:, None]
        inside += np.maximum(np.diagonal(step[1::2, 2::2]), np.diagonal(step[2::2, 2::2]))[:, None]
        gain = begin[0].copy()
        most = gain.copy()
        for k in range(1, len(e)):
            gain += inside[k]
            np.maximum(gain, begin[k], out=gain)
            np.maximum(most, gain, out=most)
        most = np.maximum(most + np.maximum(step[1::2, 0], step[2::2, 0])[:, None], gain)  # a span may also go on at the end
        live = np.flatnonzero(most.max(0) > -1e-3)
        tags = np.zeros((e.shape[1], len(e)), np.int64)
        if len(live):
            tags[live] = self._best_paths(e[:, live])
        return tags

    def _best_paths(self, e: np.ndarray) -> np.ndarray:
        t, n, _ = e.shape
        best = np.ascontiguousarray(e.transpose(0, 2, 1))  # scores of the best paths that end in each tag: [time, tag, window]
        into = np.ascontiguousarray(self.step.T)[:, :, None]
        ways, most = np.empty((N_TAGS, N_TAGS, n), np.float32), np.empty((N_TAGS, n), np.float32)
        for k in range(1, t):
            np.add(into, best[k - 1][None], out=ways)
            np.maximum.reduce(ways, axis=1, out=most)
            best[k] += most
        tags = np.empty((n, t), np.int64)
        tags[:, -1] = best[-1].argmax(0)
        for k in range(t - 1, 0, -1):  # only the way back is looked up
            tags[:, k - 1] = (best[k - 1].T + into[tags[:, k], :, 0]).argmax(1)
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood a character, and its gradients."""
        n, t = x.shape
        H = self.hidden
        tape: list = []
        out = self._run(x, tape)
        e = self._emissions(out).astype(np.float64)
        step = self.step.astype(np.float64)
        ways, chances = np.exp(step), np.exp(e - e.max(2, keepdims=True))
        # forward and backward probabilities, scaled to one at each character
        ahead, behind, scales = np.empty_like(e), np.empty_like(e), np.empty((t, n))
        ahead[0] = chances[0]
        for k in range(t):
            if k:
                ahead[k] = (ahead[k - 1] @ ways) * chances[k]
            scales[k] = ahead[k].sum(1)
            ahead[k] /= scales[k][:, None]
        behind[-1] = 1
        for k in range(t - 2, -1, -1):
            behind[k] = ((chances[k + 1] * behind[k + 1]) @ ways.T) / scales[k + 1][:, None]
        whole = np.log(scales).sum(0) + e.max(2).sum(0)
        of_time, of_row = np.arange(t)[:, None], np.arange(n)[None]
        gold = e[of_time, of_row, y.T].sum(0) + step[y[:, :-1], y[:, 1:]].sum(1)
        de = ahead * behind
        later = chances[1:] * behind[1:] / scales[1:][:, :, None]
        d_step = np.einsum("tni,tnj->ij", ahead[:-1], later) * ways
        np.add.at(d_step, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        de[of_time, of_row, y.T] -= 1
        scale = 1 / (n * t)
        de, d_step = (de * scale).astype(np.float32), d_step * scale
        both = np.concatenate([out[0], out[1, ::-1]], 2)
        grad = {"out": np.einsum("tnh,tng->hg", both, de, optimize=True), "bias": de.sum((0, 1)), "step": d_step.astype(np.float32)}
        d_both = de @ self.p["out"].T
        d_out = np.stack([d_both[:, :, :H], d_both[::-1, :, H:]])
        dh, dc = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)
        dzs = np.empty((2, t, n, 4 * H), np.float32)
        gh, back = np.zeros_like(self.p["h"]), self.p["h"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            z, tc, before_h, before_c = tape[k]
            i, f, o, a = (z[:, :, j * H : (j + 1) * H] for j in range(4))
            dh += d_out[:, k]
            dc += dh * o * (1 - tc * tc)
            dz = dzs[:, k]
            dz[:, :, :H] = dc * a * i * (1 - i)
            dz[:, :, H : 2 * H] = dc * before_c * f * (1 - f)
            dz[:, :, 2 * H : 3 * H] = dh * tc * o * (1 - o)
            dz[:, :, 3 * H :] = dc * i * (1 - a * a)
            gh += before_h.transpose(0, 2, 1) @ dz
            dh = dz @ back
            dc *= f
        read = np.stack([x.T, x.T[::-1]]).reshape(2, -1)
        seen = (read[:, None, :] == np.arange(N_CLASSES)[None, :, None]).astype(np.float32)
        grad["x"], grad["h"] = seen @ dzs.reshape(2, -1, 4 * H), gh
        return float((whole - gold).sum() * scale), grad


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        out[start:end] = 2 + 2 * k
        out[start] = 1 + 2 * k
    return out


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one kind's tags that start with its beginning."""
    out, start, kind = [], None, -1
    for i in [*np.flatnonzero(np.diff(tags, prepend=0, append=0)).tolist()]:
        tag = int(tags[i]) if i < len(tags) else 0
        if start is not None and tag != 2 + 2 * kind:
            out.append((KINDS[kind], start, i))
            start = None
        if tag % 2:
            start, kind = i, (tag - 1) // 2
    return out


#: Forms beyond the base patterns, each a kind and its name.
LOOSE_FORMS = (
    ("email", "spelled"), ("email", "bracketed"), ("email", "half bracketed"), ("ip", "spelled"), ("ip", "defanged"), ("card", "dotted"), ("card", "slashed"), ("card", "underscored"),
    ("phone", "area in brackets"), ("phone", "dashed"), ("phone", "dotted"), ("phone", "trunk zero"), ("phone", "slash"), ("phone", "double zero"), ("phone", "bare"),
)


def loose_form(form: tuple[str, str], rng: random.Random) -> tuple[str, str]:
    """(kind, text) of a random span in one of ``LOOSE_FORMS``."""
    kind, name = form

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    if kind == "email":
        local, domain, top = rng.choice((word(), f"{word()}.{word()}", f"{word()}{digits(2)}")), word(), rng.choice(("com", "org", "net", "de", "io"))
        if name == "spelled":
            return kind, f"{local.replace('.', ' dot ')} at {domain} dot {top}"
        left, right = rng.choice(("[]", "()", "{}"))
        gap = rng.choice(("", " "))
        if name == "bracketed":
            return kind, f"{local}{gap}{left}at{right}{gap}{domain}{gap}{left}dot{right}{gap}{top}"
        return kind, f"{local}{gap}{left}at{right}{gap}{domain}.{top}"
    if kind == "ip":
        return kind, (" dot " if name == "spelled" else rng.choice(("[.]", "(.)"))).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return kind, {"dotted": ".", "slashed": "/", "underscored": "_"}[name].join(body[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return kind, {"area in brackets": f"({a}) {b}-{c}", "dashed": f"{a}-{b}-{c}", "dotted": f"{a}.{b}.{c}", "trunk zero": f"0{a} {b} {c}", "slash": f"0{a[:2]}/{b}{c}{a[2]}", "double zero": f"00{rng.randint(1, 99)} {a} {b}{c}", "bare": f"{rng.choice('23456789')}{a[1:]}{b}{c}"}[name]


def examples(texts: list[str], count: int, window: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: stretches of the texts in which spans of each kind, in many forms, and look-alikes that are none were set.

    Texts give the surroundings and what their own base patterns label.
    """
    rng = random.Random(seed)
    texts = [t for t in texts if t.strip()] or ["a text of words and more words"]

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word(lo: int = 2, hi: int = 9) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(lo, hi)))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((13, 14, 14, 14, 14)))
        body += next(c for c in "0123456789" if luhn(body + c))
        return rng.choice((body, body, " ".join(body[i : i + 4] for i in range(0, len(body), 4)), "-".join(body[i : i + 4] for i in range(0, len(body), 4))))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        lead = f"+{rng.randint(1, 99)}"
        return lead + rng.choice((f" ({a}) {b}-{c}", f" {a} {b} {c}", f"-{a}-{b}-{c}", f" {a}.{b}.{c}", f"{a}{b}{c}"))

    def email() -> str:
        return rng.choice((word(), f"{word()}.{word()}", f"{word()}_{word(1, 4)}", f"{word()}.{word()}{digits(2)}")) + "@" + ".".join([*(rng.choice((word(), word() + digits(1))) for _ in range(rng.randint(1, 2))), rng.choice(("com", "org", "net", "example.com", "de"))])

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def secret() -> str:
        return f'{rng.choice(("token", "key", "secret"))} = "{"".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40))))}"'

    def other() -> str:
        return rng.choice((f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", digits(rng.randint(1, 8)), f"{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"@{word()}", f"{word()} @ {word()}", f"CC BY-NC {rng.randint(1, 4)}.0", f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{word()}{digits(2)}", secret(), secret(), digits(rng.randint(20, 26))))

    def looser() -> tuple[str, str]:
        """A form that no base pattern matches whole."""
        return loose_form(rng.choice((*LOOSE_FORMS, *LOOSE_FORMS[:4], LOOSE_FORMS[0], LOOSE_FORMS[0])), rng)  # words are harder to tell from the text around them

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    xs, ys = [], []
    for _ in range(count):
        t = rng.choice(texts)
        i = rng.randrange(max(1, len(t) - window))
        words = re.sub(r"\S*[0-9@]\S*", "", t[i : i + window]).split(" ")
        places = set(rng.sample(range(len(words)), min(len(words), rng.randint(1, 3))))
        t, forced = "", []
        for k, w in enumerate(words):
            if k in places:
                kind = rng.choice((*KINDS, "looser", "looser", "looser", "looser", None, None, None))
                named, put = looser() if kind == "looser" else (None, makers[kind]() if kind else other())
                if named:
                    forced.append((named, len(t), len(t) + len(put)))
                t += put + rng.choice(("", "", ".", ",", "!!", "%%%", "***")) + " "
            t += w + " "
        t = t[:window].ljust(window)
        if rng.random() < 0.15:
            t = "".join(c.upper() if c.isascii() else c for c in t)
        forced = [f for f in forced if f[2] <= window]
        # part of a looser form may fit a base pattern: the whole form is what is to be learnt
        spans = forced + [s for s in base_spans(t) if not any(a < s[2] and s[1] < b for _, a, b in forced)]
        xs.append(classes(t))
        ys.append(tags_of(window, _apart(sorted(spans, key=lambda s: s[1]))))
    return np.array(xs), np.array(ys)


def _apart(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans without those that overlap an earlier one (tags hold one kind at a place)."""
    out: list[tuple[str, int, int]] = []
    for s in spans:
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def train(texts: list[str], steps: int = 1300, batch: int = 64, window: int = 96, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Adam on labelled windows; everything is seeded."""
    model = Tagger.fresh(seed=seed)
    x, y = examples(texts, 20000, window)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        _, grad = model.gradients(x[pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.p[k] = (model.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# --- whole texts -------------------------------------------------------------------------------------------------------------------

#: Characters on each side of a seam whose scores are joined, and by how much windows overlap on each side of it.
SIDE, MARGIN = 96, 32


def tag_text(model: Tagger, texts: list[str], window: int = 512, stride: int = 512 - 2 * MARGIN, most: int = 384, step: int = 128) -> list[np.ndarray]:
    """Tags of whole texts, every character of them decoded. At most ``most`` windows are decoded at once; a text's last one is padded to a multiple of ``step``.

    Windows meet at seams in the middle of their overlaps. Around each the scores of both, each window's on its own side, are joined and decoded as one
    stretch; from the seam to where both decodings are outside, those tags count in place of the windows' own. So a span over a seam
    is found like any other, as long as it has at most ``SIDE`` characters on each side.
    """
    out = [np.zeros(len(t), np.int8) for t in texts]
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    halves: dict[tuple[int, int], np.ndarray] = {}
    seams: list[tuple[int, int, np.ndarray]] = []

    def flush(todo: list[tuple[int, int, np.ndarray]]) -> None:
        e = model.scores(np.array([w for _, _, w in todo]))
        found, whole = model.paths(e), []
        for j, ((i, start, _), tags) in enumerate(zip(todo, found)):
            # the middle of a window is its own; a text's first and last characters belong to the windows that begin and end it
            n = len(out[i])
            lo = start if start == 0 else start + MARGIN
            last = start + stride >= n - 2 * MARGIN
            hi = n if last else start + stride + MARGIN
            out[i][lo:hi] = tags[lo - start : hi - start]
            for at, half in ([(lo, e[MARGIN : MARGIN + SIDE, j])] if start else []) + ([] if last else [(hi, e[stride + MARGIN - SIDE : stride + MARGIN, j])]):
                other = halves.pop((i, at), None)
                if other is None:
                    halves[i, at] = half.copy()
                else:
                    whole.append((i, at, np.concatenate([half, other] if at == hi else [other, half])))
        todo.clear()
        if whole:
            e = np.stack([x for _, _, x in whole], axis=1)
            e[0] += model.step[0]
            seams.extend((i, at, tags.astype(np.int8)) for (i, at, _), tags in zip(whole, model.paths(e)))

    for i, t in enumerate(texts):
        x = classes(t)
        for start in range(0, max(1, len(t) - 2 * MARGIN) if t else 0, stride):
            part = x[start : start + window]
            w = np.full(-(-len(part) // step) * step, _CLASS[32])
            w[: len(part)] = part
            todo = waiting.setdefault(len(w), [])
            todo.append((i, start, w))
            if len(todo) >= most:
                flush(todo)
    for todo in waiting.values():
        if todo:
            flush(todo)
    for i, at, tags in seams:
        own = out[i][at - SIDE : at + SIDE]
        tags = tags[: len(own)]
        outside = np.flatnonzero((own == 0) & (tags == 0))
        before, after = outside[outside < SIDE], outside[outside >= SIDE]
        a, b = (before[-1] + 1 if len(before) else 0), (after[0] if len(after) else len(own))
        own[a:b] = tags[a:b]
    return out


def _portions(texts: list[str | None], rows: int = 1000, chars: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of at most ``rows`` texts and about ``chars`` characters (or one text); nulls are empty."""
    held, size = [], 0
    for t in texts:
        if held and (len(held) >= rows or size + len(t or "") > chars):
            yield held
            held, size = [], 0
        held.append(t or "")
        size += len(t or "")
    if held:
        yield held


_AT = r"(?:@|\s*[\[({]\s*(?:at|@)\s*[\])}]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+)"
_ADDRESS = re.compile(rf"[a-z0-9_%+-]+(?:{_DOT}[a-z0-9_%+-]+)*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.I)
_FOUR_PARTS = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I)
_ASCII_DIGITS = re.compile(r"[0-9]+")


def _valid(kind: str, s: str) -> bool:
    """What a span of the kind must mean, however it is written, so that a stray tag adds nothing."""
    digits = "".join(_ASCII_DIGITS.findall(s))
    if kind == "email":
        return _ADDRESS.fullmatch(s) is not None
    if kind == "ip":
        return _FOUR_PARTS.fullmatch(s) is not None and all(int(x) <= 255 for x in _ASCII_DIGITS.findall(s))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not set(s) - set("0123456789 .-/_")
    return 9 <= len(digits) <= 15 and not set(s) - set("0123456789 ().-/+")


#: What every valid span of a kind holds: an address's sign and what follows it; four parts; nine digits and marks between them.
_AT_WORD = re.compile(r"[\s\[({]at[\s\])}]", re.I)
_HALF_ADDRESS = re.compile(rf"[a-z0-9_%+-]{_AT}[a-z0-9-]+{_DOT}[a-z0-9-]", re.I)
_NINE_DIGITS = re.compile(r"[0-9](?:[ ().\-/+_]*+[0-9]){8}")


def may_hold(text: str) -> bool:
    """Whether any stretch of the text is ``_valid`` for some kind (or may be: what is asked here is part of what is asked there)."""
    if _ASCII_DIGITS.search(text) and (_NINE_DIGITS.search(text) or _FOUR_PARTS.search(text)):
        return True
    return ("@" in text or _AT_WORD.search(text) is not None) and _HALF_ADDRESS.search(text) is not None


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text: what the model finds is added where it overlaps no base span and is whole and well-formed.

    Texts that can hold no such span are spared the model; every other one is decoded whole.
    """
    out = []
    asked = [may_hold(t) for t in texts]
    decoded = iter(tag_text(model, [t for t, a in zip(texts, asked) if a]))
    for t, a in zip(texts, asked):
        tags = next(decoded) if a else np.zeros(0, np.int8)
        base = base_spans(t) if "@" in t or _ASCII_DIGITS.search(t) else []
        extra = []
        for kind, start, end in spans_of(tags) if tags.any() else ():
            while end > start and not t[end - 1].isalnum():
                end -= 1
            while start < end and not t[start].isalnum() and t[start] not in "+(":
                start += 1
            clear = not any(a < end and start < b for _, a, b in base)
            whole = (start == 0 or not t[start - 1].isalnum()) and (end == len(t) or not t[end].isalnum())
            if clear and whole and _valid(kind, t[start:end]):
                extra.append((kind, start, end))
        out.append((base, sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, as its first kind in brackets."""
    out, free = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[free:a], f"[{kind.upper()}]"]
        free = b
    return "".join([*out, text[free:]])


#: Characters of a stretch of text, and stretches taken of each text of the sample.
STRETCH, STRETCHES = 160, 16


def fit(docs: DataFrame, sample: int = 400) -> Tagger:
    """Train, in one task, on stretches of at most ``sample`` texts (those whose text hashes are smallest): the surroundings into which labelled spans are set.

    ``STRETCHES`` places of each text, dealt by its hash over its whole length, give ``STRETCH`` characters each, so that the sample is
    bounded however long the texts are. Only the parameters come to the driver.
    """
    hashed = docs.where("text <> ''").select("text", F.xxhash64("text").alias("h"))
    # hashes alone are ordered; at most ``sample`` of them are broadcast
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample)
    at = lambda k: F.pmod(F.xxhash64("h", k), F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1).cast("int") + 1
    places = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substring(F.col("text"), at(k), F.lit(STRETCH)))
    found = hashed.join(F.broadcast(chosen), "h").select("h", places.alias("parts")).groupBy("h").agg(F.min("parts").alias("parts"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in batches for parts in batch.column(1).to_pylist() for t in parts]
        yield pa.RecordBatch.from_arrays([pa.array([train(texts).dump()], pa.binary())], names=["model"])

    got = found.repartition(1).sortWithinPartitions("h").mapInArrow(lean(learn), "model binary").first()
    return Tagger.load(got["model"]) if got else train([])


def detect(docs: DataFrame, model: Tagger | None = None, sample: int = 400) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (kind:start:end, comma-joined, in code points) and ``redacted`` (the text with every span replaced).

    Columns of these names are replaced. Null texts are empty and stay null when redacted; every row is judged for itself, so nulls and
    repeats in other columns don't matter; an empty table gives no rows.
    """
    raw = docs.sparkSession.sparkContext.broadcast((model or fit(docs, sample)).dump())
    plain = docs.drop("base_spans", "spans", "redacted")

    @F.arrow_udf("struct<base_spans string, spans string, redacted string>")
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger.load(raw.value)
        yield from lean(lambda parts: (one(tagger, c.to_pylist()) for c in parts))(columns)

    def one(tagger: Tagger, texts: list[str | None]) -> pa.Array:
        found = [f for part in _portions(texts) for f in find_spans(tagger, part)]
        parts = [[written(b) for b, _ in found], [written(s) for _, s in found], [t if t is None or not s else redact(t, s) for t, (_, s) in zip(texts, found)]]
        return pa.StructArray.from_arrays([pa.array(p, pa.string()) for p in parts], ["base_spans", "spans", "redacted"])

    return plain.withColumn("__pii", judge(F.col("text"))).select(*plain.columns, "__pii.base_spans", "__pii.spans", "__pii.redacted")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
