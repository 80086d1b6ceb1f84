"""Personal data: base patterns, and a character BiLSTM with CRF transitions.

The base patterns give spans that always stay. A bidirectional LSTM over
characters, with a linear-chain CRF on top, is trained in numpy from labelled
spans (see training_rows) and adds spans in forms the patterns miss: spelled-out
and spaced addresses, phone numbers without a plus sign, cards in other groups,
and as a fifth kind, kept in columns of its own, secrets (keys, tokens, passwords).

Every character of every text is read. Windows of WINDOW characters overlap by
BLOCK; where two meet, their emission scores are averaged, and one Viterbi pass
over the joined scores gives the tags, so a span may cross windows. It runs
over the stretches where a span could outscore no span (see `could_hold`), and
REACH blocks around. An added span is a run of tags as decoded; it must overlap no base span
and keep its kind's limits (parts to 255, Luhn, numbers of digits). Texts beyond
PIECE characters are read in pieces that share SEAM of them; a span counts in the
piece whose middle it starts in.

Defined cases: a null text is empty; spans count code points, end exclusive;
repeated rows are read each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import arrow_map, slices

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)  # the model's own kind
BLOCK = 32
WINDOW = 8 * BLOCK
PIECE, SEAM = 1 << 16, 512
LOT = 8 * PIECE  # characters tagged at once
STRETCHES = 1 << 18  # characters of stretches that wait to be decoded together
MARGIN, REACH = 0.5, 1
HIDDEN, EMBED, CHARS = 12, 12, 100
TAGS = 1 + 2 * (len(KINDS) + 1)  # outside, then begin and inside of each kind

# The base patterns; the look-behind and possessive quantifiers only spare
# retries that could not succeed.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9][0-9.\x20-]{6,}")  # all that an ip or card may stand in
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, in order."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at) if at > last and text[at - 1] in _LOCAL_CHARS else None
        if m:
            s = at
            while s > last and text[s - 1] in _LOCAL_CHARS:
                s -= 1
            out.append((s, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    for run in _NUMBERS.finditer(text):
        for m in _IP.finditer(text, *run.span()):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and (len(p) < 5 or not p[:-4].strip("0")) for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, *run.span()):
            if m.end() - m.start() < 60:
                digits = re.sub("[^0-9]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- model


def char_ids(codes: np.ndarray) -> np.ndarray:
    """0 pads; ASCII from space on 1-95, line feed 96, other control 97, other
    Latin 98, all else 99."""
    return _IDS[np.minimum(codes, len(_IDS) - 1)]


_IDS = np.full(0x251, 99, np.int16)
_IDS[:32], _IDS[32:127], _IDS[0xC0:0x250] = 97, np.arange(1, 96), 98
_IDS[10] = 96


def _sig(x):
    return 1 / (1 + np.exp(-x))


def _run_lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool):
    """Hidden states of inputs x [time, rows, width]; w stacks input and hidden
    weights for the gates in, forget, out and cell."""
    t, n, e = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out = np.empty((t, n, HIDDEN), x.dtype)
    trace = []
    feed = x @ w[:e] + b
    for k in range(t):
        z = feed[k] + h @ w[e:]
        g = _sig(z[:, : 3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        u = np.tanh(z[:, 3 * HIDDEN :])
        before, old = c, h
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[k] = h
        if keep:
            trace.append((i, f, o, u, before, old, tc))
    return out, trace


def _back_lstm(x, w, trace, d_out):
    t, n, e = x.shape
    dz = np.empty((t, n, 4 * HIDDEN), x.dtype)
    dh, dc = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    dw = np.zeros_like(w)
    for k in range(t - 1, -1, -1):
        i, f, o, u, before, old, tc = trace[k]
        dh = dh + d_out[k]
        dc = dc + dh * o * (1 - tc * tc)
        z = dz[k]
        z[:, :HIDDEN] = dc * u * i * (1 - i)
        z[:, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
        z[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        z[:, 3 * HIDDEN :] = dc * i * (1 - u * u)
        dw[e:] += old.T @ z
        dh, dc = z @ w[e:].T, dc * f
    dw[:e] = np.tensordot(x, dz, ((0, 1), (0, 1)))
    return dz @ w[:e].T, dw, dz.sum((0, 1))


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _space(room: dict, name: str, *shape: int) -> np.ndarray:
    """An array of any content, in memory that the room keeps from call to call."""
    size = int(np.prod(shape))
    if name not in room or len(room[name]) < size:
        room[name] = np.empty(size, np.float32)
    return room[name][:size].reshape(shape)


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 10):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": g(CHARS, EMBED) * 3, "wf": g(EMBED + HIDDEN, 4 * HIDDEN), "wb": g(EMBED + HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32), "bb": np.zeros(4 * HIDDEN, np.float32), "wo": g(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS, np.float32), "tr": np.zeros((TAGS, TAGS), np.float32)}
        for b in ("bf", "bb"):
            self.p[b][HIDDEN : 2 * HIDDEN] = 1

    def scores(self, ids: np.ndarray, keep: bool = False):
        """Emission scores [time, rows, tags] of character ids [rows, time]."""
        p = self.p
        x = p["emb"][ids.T]
        hf, tf = _run_lstm(x, p["wf"], p["bf"], keep)
        hb, tb = _run_lstm(x[::-1], p["wb"], p["bb"], keep)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        return h @ p["wo"] + p["bo"], (x, h, tf, tb)

    def loss(self, ids: np.ndarray, tags: np.ndarray):
        """Mean negative log likelihood of the tag rows, and its gradients."""
        p = self.p
        em, (x, h, tf, tb) = self.scores(ids, keep=True)
        t, n, _ = em.shape
        gold = tags.T
        rows = np.arange(n)
        alpha = [em[0]]
        for k in range(1, t):
            alpha.append(_lse(alpha[-1][:, :, None] + p["tr"], 1) + em[k])
        z = _lse(alpha[-1], 1)
        beta = np.zeros((n, TAGS), np.float32)
        d_em, d_tr = np.empty_like(em), np.zeros_like(p["tr"])
        for k in range(t - 1, -1, -1):
            d_em[k] = np.exp(alpha[k] + beta - z[:, None])
            if k:
                ahead = em[k] + beta
                pair = np.exp(alpha[k - 1][:, :, None] + p["tr"] + ahead[:, None, :] - z[:, None, None])
                d_tr += pair.sum(0)
                beta = _lse(p["tr"][None] + ahead[:, None, :], 2)
        path = em[np.arange(t)[:, None], rows, gold].sum() + p["tr"][gold[:-1], gold[1:]].sum()
        for k in range(t):
            d_em[k, rows, gold[k]] -= 1
        np.subtract.at(d_tr, (gold[:-1], gold[1:]), 1)
        d_em /= n
        g = {"tr": d_tr / n, "wo": np.tensordot(h, d_em, ((0, 1), (0, 1))), "bo": d_em.sum((0, 1))}
        dh = d_em @ p["wo"].T
        dxf, g["wf"], g["bf"] = _back_lstm(x, p["wf"], tf, dh[:, :, :HIDDEN])
        dxb, g["wb"], g["bb"] = _back_lstm(x[::-1], p["wb"], tb, dh[::-1, :, HIDDEN:])
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], ids.T, dxf + dxb[::-1])
        return float((z.sum() - path) / n), g

    def emissions(self, ids: np.ndarray, room: dict | None = None) -> np.ndarray:
        """scores() without a trace, [time, tags, rows]: rows innermost, both directions in
        one step, the backward one from the last place. One product a step over embedding,
        state and a 1 for the bias gives the gates, and the scores of the step before. With
        s(x) = 1 / (1 + exp(-x)) a tanh is 2 s(2x) - 1, so that one exp and one quotient
        serve all gates. Cells are kept times -2, states halved. The result lies in the
        room, if one is given."""
        room = {} if room is None else room
        p, n, e = self.p, HIDDEN, EMBED
        ids = np.ascontiguousarray(ids.T, np.intp)
        t, rows = ids.shape
        weights = np.zeros((2, 4 * n + TAGS, e + n + 1), np.float32)
        for part, (w, b) in enumerate((("wf", "bf"), ("wb", "bb"))):
            weights[part, : 4 * n] = np.vstack([p[w], p[b]]).T
            weights[part, 4 * n :, e:-1] = p["wo"][part * n : part * n + n].T
        weights[:, : 3 * n] *= -1
        weights[:, 3 * n : 4 * n] *= -2
        weights[:, :, e:-1] *= 2
        weights[0, 4 * n :, -1] = p["bo"]
        letters = np.ascontiguousarray(p["emb"].T)
        given = _space(room, "given", t, e, rows)
        for k in range(t):
            np.take(letters, ids[k], axis=1, out=given[k], mode="clip")
        feed = np.zeros((2, e + n + 1, rows), np.float32)
        feed[:, -1] = 1
        z, u, c = np.empty((2, 4 * n + TAGS, rows), np.float32), np.empty((2, n, rows), np.float32), np.zeros((2, n, rows), np.float32)
        ahead, back, h, gates = feed[0, :e], feed[1, :e], feed[:, e:-1], z[:, : 4 * n]
        rest = gates[:, n:]
        z_in, z_old, z_out, z_new = (z[:, k * n : k * n + n] for k in range(4))
        out = _space(room, "out", t, TAGS, rows)
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
            for k in range(t + 1):
                if k < t:
                    ahead[...] = given[k]
                    back[...] = given[t - 1 - k]
                np.matmul(weights, feed, out=z)
                for at, scores, new in ((k - 1, z[0, 4 * n :], 2 * k < t + 2), (t - k, z[1, 4 * n :], 2 * k < t + 1)) if k else ():
                    if new:
                        out[at] = scores
                    else:
                        out[at] += scores
                if k == t:
                    break
                np.exp(gates, out=gates)
                np.add(gates, 1, out=gates)
                np.divide(-4, z_in, out=z_in)
                np.divide(1, rest, out=rest)
                np.subtract(z_new, 0.5, out=u)
                np.multiply(u, z_in, out=u)
                np.multiply(c, z_old, out=c)
                np.add(c, u, out=c)
                np.exp(c, out=u)
                np.add(u, 1, out=u)
                np.divide(1, u, out=u)
                np.subtract(u, 0.5, out=u)
                np.multiply(u, z_out, out=h)
        return out

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best tags [rows, time] of emission scores [time, rows, tags]. Only scores are
        kept on the way; where they came from is asked along the best path alone."""
        em = np.ascontiguousarray(em.transpose(0, 2, 1))
        t, _, n = em.shape
        tr = self.p["tr"]
        best = np.empty_like(em)
        best[0] = em[0]
        step = np.empty((TAGS, TAGS, n), em.dtype)
        for k in range(1, t):
            np.add(best[k - 1][:, None], tr[:, :, None], out=step)
            np.max(step, axis=0, out=best[k])
            best[k] += em[k]
        out = np.empty((n, t), np.int8)
        tag = best[-1].argmax(0)
        out[:, -1] = tag
        for k in range(t - 1, 0, -1):
            tag = (best[k - 1] + tr[:, tag]).argmax(0)
            out[:, k - 1] = tag
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi tags [rows, time]."""
        return self.viterbi(self.emissions(ids).transpose(0, 2, 1))


class Forms:
    """Invented private data in many written forms, and things that look alike."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.make = (self.email, self.ip, self.card, self.phone, self.secret)

    def pick(self, s):
        return s[int(self.r.integers(len(s)))]

    def digits(self, k: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, k)))

    def many(self, low: int, high: int) -> int:
        return int(self.r.integers(low, high))

    def word(self, low: int = 1, high: int = 11) -> str:
        if self.r.random() < 0.2:  # common short words, sentence starts among them
            w = self.pick(("at", "at", "to", "is", "in", "of", "the", "and", "by", "be", "as", "or", "it", "on", "dot", "de", "le", "un", "es", "ich", "at the", "is at"))
            return w.capitalize() if self.r.random() < 0.15 else w
        w = "".join(self.pick("eeettaaooiinnsshhrrdlucmfwypvbgkqxzjéüñçß") for _ in range(self.many(low, high)))
        u = self.r.random()
        return w.capitalize() if u < 0.12 else w.upper() if u < 0.15 else w

    def name(self) -> str:
        return "".join(self.pick("etaoinshrdlucmfwypvbgk") for _ in range(self.many(2, 9)))

    def email(self) -> str:
        ending = self.pick(("com", "org", "net", "de", "io", "example", "co.uk", "test"))
        user = [self.name(), *([self.pick((self.name(), self.digits(2)))] if self.r.random() < 0.6 else [])]
        host = self.pick(("mail", "post", "example", self.name())) + self.pick(("", "", self.digits(1)))
        form = self.many(0, 5)
        at, dot = (("@", "."), (" at ", " dot "), self.pick(((" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "))), self.pick(((" [at] ", "."), (" (at) ", "."), ("[at]", "."), (" at ", "."))), (" @ ", self.pick((".", " . "))))[form]
        text = self.pick((dot, "_", "-") if form == 0 else (dot,)).join(user) + at + host + dot + ending.replace(".", dot)
        return text.upper() if self.r.random() < 0.05 else text

    def ip(self) -> str:
        parts = [str(x) for x in self.r.integers(0, 256, 4)]
        if self.r.random() < 0.3:
            parts = [self.pick(("10", "192", "127", "172")), *(str(self.many(0, 20)) for _ in range(3))]
        return self.pick((".", ".", " . ", "[.]", ". ", " dot ", "(.)")).join(parts)

    def card(self) -> str:
        d = self.pick("3456") + self.digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        group = [d[i : i + 4] for i in range(0, 16, 4)]
        return self.pick((d, " ".join(group), "-".join(group), ".".join(group), " - ".join(group), "/".join(group), "  ".join(group), " ".join(d), "_".join(group)))

    def phone(self) -> str:
        d = self.digits
        sep = self.pick(("-", ".", " ", "-"))
        return self.pick((
            f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+33{d(9)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}", sep.join((d(3), d(3), d(4))), sep.join((d(3), d(3), d(4))), f"1-{d(3)}-{d(3)}-{d(4)}",
            f"00{self.pick(('49', '33', '44', '1'))} {d(3)} {d(7)}", f"00{d(2)} {d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(8)}", f"0{d(3)} {d(6)}", f"0{d(3)}/{d(7)}", f"0{d(4)}-{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)}-{d(4)}-{d(4)}",
        ))

    def secret(self) -> str:
        hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        some = lambda letters, low, high: "".join(self.pick(letters) for _ in range(self.many(low, high)))
        x = self.pick((some(hexa, 24, 64), some(hexa, 32, 41), some(mixed, 20, 44), some(mixed, 28, 40) + "=", "sk-" + some(mixed, 20, 48), "ghp_" + some(mixed, 30, 40), "AKIA" + some(mixed[:26] + "0123456789", 16, 17)))
        return x.upper() if self.r.random() < 0.1 else x

    def secret_lead(self) -> str:
        key = self.pick(("token", "token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key", "auth", "key", "client_secret", "private_key"))
        key = key.upper() if self.r.random() < 0.2 else key
        return key + self.pick((" = ", "=", ": ", ":", " => ", " is ")) + self.pick(('"', '"', "'", "", ""))

    def alike(self) -> str:
        """Numbers and words that are nobody's data."""
        d, w, k = self.digits, self.word, self.many(0, 34)
        return (
            d(1), "20" + d(2), "19" + d(2), d(2) + "." + d(1), d(3), "v" + d(1) + "." + d(1) + "." + d(1), d(2) + "%", d(5), "#" + d(self.many(2, 9)), "@ " + w(), "Version " + d(1) + ".0.", d(2) + "/" + d(2) + "/" + d(4),
            d(4) + "-" + d(2) + "-" + d(2), d(2) + "." + d(2) + "." + d(4), d(2) + ":" + d(2), d(2) + ":" + d(2) + ":" + d(2), "$" + d(3) + "." + d(2), d(1) + "," + d(3) + "," + d(3), d(2) + " " + d(3), d(3) + "-" + d(3), "No. " + d(self.many(4, 11)),
            "ISBN 978-" + d(1) + "-" + d(2) + "-" + d(6) + "-" + d(1), "0." + d(6), d(1) + "." + d(1) + "." + d(1) + ".", w() + " at " + w() + " " + w(), w() + " dot " + w(), "at " + w() + ". " + w(), self.pick(("token", "secret", "password", "key", "auth")) + " " + w() + " " + w(),
            "order " + d(self.many(6, 12)), "".join(self.pick("0123456789abcdef") for _ in range(self.many(6, 13))), "CC BY-NC 4.0", w() + "/" + w() + "/" + w(), "http://www." + self.name() + ".com/" + w() + "/" + d(3), self.pick(("|", "$", "*", "~", "==", "&", "<<", "%")) + " " + self.pick(("|", "$", "---", "||", "#")),
        )[k]

    def gap(self) -> str:
        return self.pick((" ", " ", " ", " ", " ", ", ", ".\n", ". ", "\n", "; ", " - ", "! "))


def labelled_text(forms: Forms, length: int, share: float = 0.10) -> tuple[str, list[int]]:
    """A text of at least `length` characters and the tag of each."""
    text, tag = "", []
    while len(text) < length:
        u = forms.r.random()
        if u < share:
            k = forms.many(0, len(forms.make))
            lead = forms.secret_lead() if k == SECRET else forms.pick(("", "", "", "", "call ", "tel. ", "mail: ", "IP ", "host ", "card ", "phone: ", "contact "))
            s = forms.make[k]()
            close = lead[-1] if k == SECRET and lead[-1] in "\"'" else ""
            text += lead + s + close
            tag += [0] * len(lead) + [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1) + [0] * len(close)
        else:
            s = forms.alike() if u < share + 0.12 else forms.word()
            text += s
            tag += [0] * len(s)
        gap = forms.gap()
        text += gap
        tag += [0] * len(gap)
    return text, tag


def training_rows(n: int, seed: int, length: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Labelled character rows, cut anywhere in a text."""
    forms = Forms(seed)
    ids, tags = np.zeros((n, length), np.int64), np.zeros((n, length), np.int64)
    for row in range(n):
        text, tag = labelled_text(forms, length + 40)
        off = forms.many(0, 40)
        ids[row] = char_ids(np.frombuffer(text.encode("utf-32-le"), "<u4"))[off : off + length]
        tags[row] = tag[off : off + length]
        if row % 4 == 0:  # the end of a text is padding
            end = forms.many(length // 4, length)
            ids[row, end:], tags[row, end:] = 0, 0
    return ids, tags


@functools.lru_cache(maxsize=2)
def trained(steps: int = 800, seed: int = 10) -> Tagger:
    """The tagger fitted by Adam; the same for every call in a process."""
    model = Tagger(seed)
    ids, tags = training_rows(4000, seed)
    r = np.random.default_rng(seed + 1)
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        at = r.integers(0, len(ids), 48)
        _, g = model.loss(ids[at], tags[at])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.015 * min(1.0, 1.6 * (1 - step / (steps + 1)))
        for k, x in g.items():
            x = x * min(1.0, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * x
            m2[k] = 0.99 * m2[k] + 0.01 * x * x
            model.p[k] = (model.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


_NAME = r"[A-Za-z0-9_+%-]+"
ADDRESSES = tuple(
    re.compile(f"{_NAME}(?:{dot}{_NAME})*{at}{_NAME}(?:{dot}{_NAME})*{dot}[A-Za-z]{{2,}}", re.I)
    for at, dot in ((r" ?@ ?", r" ?\. ?"), (" at ", " dot "), (" at ", r"\."), (r" ?[\[(] ?at ?[\])] ?", r"(?: ?[\[(] ?dot ?[\])] ?|\.)"))
)


def sound(kind: int, text: str) -> bool:
    """Whether an added span keeps its kind's own limits."""
    parts = re.findall("[0-9]+", text)
    many = sum(map(len, parts))
    if kind == 0:  # one user, one host with an ending; a spelled-out "at" is in one form with its dots
        return any(p.fullmatch(text) for p in ADDRESSES)
    if kind == 1:
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 12 <= many <= 19 and luhn("".join(parts))
    if kind == 3:
        return 7 <= many <= 15
    return len(text) >= 16 and many > 0 and not re.search(r"\s", text)


class Windows:
    """Emission scores of pieces of character ids, piece after piece in blocks. Window w
    has the blocks from start[w] on; first tells each piece's first block, and the end.
    A block where two windows meet has the mean of both. The scores lie in the room."""

    def __init__(self, pieces: list[np.ndarray], model: Tagger, room: dict):
        many = WINDOW // BLOCK
        count = np.array([max(1, -(-(len(x) - BLOCK) // (WINDOW - BLOCK))) for x in pieces], np.int64)
        self.first = np.concatenate(([0], np.cumsum((many - 1) * count + 1)))
        flat = np.zeros(int(self.first[-1]) * BLOCK, np.int16)
        for x, b in zip(pieces, self.first.tolist()):
            flat[b * BLOCK : b * BLOCK + len(x)] = x
        self.start = np.repeat(self.first[:-1], count) + (many - 1) * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        windows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::BLOCK]
        self.em = model.emissions(windows[self.start], room).reshape(many, BLOCK, TAGS, len(self.start))
        self.met = np.bincount(np.concatenate([self.start, self.start + many - 1]), minlength=int(self.first[-1])) > 1

    def sums(self, tr: np.ndarray) -> np.ndarray:
        """Of each block and kind of span (see could_hold), [4, blocks, kinds]: the sum of
        the gains of its places, and the best sum from its first place on, up to its last,
        and anywhere in it. Where two windows meet it is the mean of both, which is no less
        than that of the mean scores."""
        many, _, _, n = self.em.shape
        moves = _moves(tr).astype(np.float32)[:, None]
        gain = np.empty((TAGS // 2, n), np.float32)
        out = np.zeros((4, int(self.first[-1]), TAGS // 2), np.float32)
        for j in range(many):
            stats = np.full((4, TAGS // 2, n), -1e9, np.float32)
            whole, begun, ended, inside = stats
            whole[...] = 0
            for x in self.em[j]:
                np.maximum(x[1::2], x[2::2], out=gain)
                np.subtract(gain, x[0], out=gain)
                np.add(gain, moves, out=gain)
                np.maximum(ended, 0, out=ended)
                np.add(ended, gain, out=ended)
                np.maximum(inside, ended, out=inside)
                np.add(whole, gain, out=whole)
                np.maximum(begun, whole, out=begun)
            out[:, self.start + j] += stats.transpose(0, 2, 1)  # at most one window has a block as its j-th
        out[:, self.met] *= 0.5
        return out

    def scores(self, blocks: np.ndarray) -> np.ndarray:
        """[blocks, BLOCK, tags]"""
        window = np.searchsorted(self.start, blocks, "right") - 1
        out = self.em[blocks - self.start[window], :, :, window]
        met = self.met[blocks]
        out[met] += self.em[-1][:, :, window[met] - 1].transpose(2, 0, 1)
        out[met] *= 0.5
        return out


def model_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) that the tagger finds in each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pieces, owner = [], []
    room: dict = {}
    found: list[tuple] = []  # owner, place in its piece, and scores of each stretch

    def decode():
        for (i, off, low, high, size), at, spans in zip(*zip(*((o, at) for o, at, _ in found)), _decoded([em for _, _, em in found], model)):
            out[i] += [(off + at + s, k, off + min(at + e, size)) for s, k, e in spans if low <= at + s < high]
        found.clear()

    def flush():
        for piece, at, em in _stretches(pieces, model, room):
            found.append((owner[piece], at, em))
        pieces.clear()
        owner.clear()
        if sum(em.shape[1] for _, _, em in found) > STRETCHES:
            decode()

    held = 0
    for i, text in enumerate(texts):
        codes = char_ids(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
        off = 0
        while off == 0 or off + SEAM < len(codes):
            x = codes[off : off + PIECE]
            last = off + PIECE >= len(codes)
            pieces.append(x)
            owner.append((i, off, SEAM // 2 if off else 0, len(x) if last else PIECE - SEAM // 2, len(x)))
            held += max(len(x), WINDOW)
            if held >= LOT:
                flush()
                held = 0
            off += PIECE - SEAM
    if pieces:
        flush()
    if found:
        decode()
    return [sorted(x) for x in out]


def _moves(tr: np.ndarray) -> np.ndarray:
    """What a move within a span of each kind gains, at most, over one outside."""
    b = np.arange(1, TAGS, 2)
    return np.maximum(tr[b, b + 1], tr[b + 1, b + 1]) - tr[0, 0]


def could_hold(sums: np.ndarray, first: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Blocks that a span of some kind may touch, from Windows.sums and each piece's first
    block. A span of one kind gains, over no span, at most the sum of its places' best
    scores less the outside ones, and its best transitions. Where the best sum of a run of
    places that touches the block stays MARGIN below 0 no span does."""
    whole, begun, ended, inside = sums.astype(np.float64)
    apart = np.zeros((len(whole) + 1, 1), bool)
    apart[first] = apart[-1] = True
    upto = np.cumsum(whole - 1e6 * apart[:-1], axis=0)  # nothing spans two pieces
    before, after = np.zeros_like(whole), np.zeros_like(whole)
    before[1:] = np.maximum.accumulate(ended - upto)[:-1] + upto[:-1]
    after[:-1] = np.maximum.accumulate((begun[1:] + upto[:-1] - 1e6 * apart[1:-1])[::-1])[::-1] - upto[:-1]
    before, after = np.maximum(np.where(apart[:-1], 0, before), 0), np.maximum(np.where(apart[1:], 0, after), 0)
    best = np.maximum(np.maximum(inside, before + begun), np.maximum(ended + after, before + whole + after))
    b = np.arange(1, TAGS, 2)
    ends = tr[0, b] + np.maximum(tr[b, 0], tr[b + 1, 0]) - tr[0, 0] - _moves(tr) - tr[0, 0]
    return (best > -MARGIN - ends).any(1)


def _stretches(pieces: list[np.ndarray], model: Tagger, room: dict):
    """(piece, place in it, emission scores [tags, places]) of the stretches of blocks
    around those that could hold a span, none across two pieces."""
    windows = Windows(pieces, model, room)
    first, tr = windows.first, model.p["tr"]
    hot = np.flatnonzero(could_hold(windows.sums(tr), first[:-1], tr))
    if not len(hot):
        return
    piece = np.searchsorted(first, hot, "right") - 1
    low, high = np.maximum(hot - REACH, first[piece]), np.minimum(hot + REACH + 1, first[piece + 1])
    new = np.concatenate(([True], (low[1:] > high[:-1]) | (piece[1:] != piece[:-1])))
    begin, end, of = low[new], high[np.append(np.flatnonzero(new)[1:], len(hot)) - 1], piece[new]
    size = end - begin
    ends = np.cumsum(size)
    em = windows.scores(np.repeat(begin - ends + size, size) + np.arange(ends[-1]))
    for a, b, e, i in zip(begin.tolist(), size.tolist(), ends.tolist(), of.tolist()):
        yield i, (a - int(first[i])) * BLOCK, em[e - b : e].reshape(-1, TAGS).T


def _decoded(scores: list[np.ndarray], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """The spans of each stretch; they go through Viterbi with stretches of like size
    (to a factor of 2), some 2^13 blocks at a time."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in scores]
    size = np.array([x.shape[1] // BLOCK for x in scores])
    order = np.argsort(size, kind="stable")
    level = np.log2(size[order]).astype(np.int64)
    part = np.arange(len(order)) // np.clip((1 << 13) >> level, 1, 1 << 9)
    cuts = np.flatnonzero((np.diff(level) != 0) | (np.diff(part) != 0)) + 1
    for group in np.split(order, cuts):
        x = np.full((len(group), TAGS, int(size[group].max()) * BLOCK), -1e4, np.float32)
        x[:, 0] = 0
        for k, g in enumerate(group.tolist()):
            x[k, :, : scores[g].shape[1]] = scores[g]
        tags = model.viterbi(x.transpose(2, 0, 1)).astype(np.int64)
        for k in np.flatnonzero(tags.any(1)).tolist():
            out[group[k]] = runs(tags[k])
    return out


def runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the spans of one row of tags: a begin tag, or a
    change of kind, starts a new one."""
    kind = (tags + 1) // 2
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | ((tags[1:] % 2 == 1) & (kind[1:] > 0))) + 1
    cuts = [0, *edge.tolist(), len(tags)]
    return [(a, int(kind[a]) - 1, b) for a, b in zip(cuts, cuts[1:]) if kind[a] > 0]


def find(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as (start, kind number, end)."""
    out = []
    for text, found in zip(texts, model_spans(texts, model)):
        base = base_spans(text)
        added = []
        for s, kind, e in found:
            while e > s and text[e - 1].isspace():
                e -= 1
            while s < e and text[s].isspace():
                s += 1
            if sound(kind, text[s:e]) and not any(x < e and s < y for x, _, y in base):
                added.append((s, kind, e))
        out.append((base, sorted(base + added)))
    return out


NAMES = (*KINDS, "secret")
DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, secrets string, n_private long"


def _joined(spans) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of those
    four kinds, added ones included; n_secret and secrets likewise, and n_private, the
    number of all spans."""
    model = trained()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = find([t or "" for t in part.column("text").to_pylist()], model)
                counts = [pa.array([sum(x[1] == k for x in (spans if k == SECRET else base)) for base, spans in found], pa.int64()) for k in range(SECRET + 1)]
                sha = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found])
                listed = [pa.array([_joined([x for x in s if (x[1] == SECRET) == own]) for _, s in found], pa.string()) for own in (False, True)]
                every = pa.array([len(s) for _, s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *counts[:SECRET], sha, listed[0], counts[SECRET], listed[1], every], [x.split()[0] for x in DIGEST.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), run, DIGEST)


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The columns of docs with every span of text replaced by its kind in brackets."""
    model = model or trained()
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                out = []
                for text, (_, spans) in zip(texts, find([t or "" for t in texts], model)):
                    at, pieces = 0, []
                    for s, k, e in spans:
                        if s >= at:
                            pieces += [text[at:s], f"[{NAMES[k].upper()}]"]
                        at = max(at, e)
                    out.append("".join([*pieces, text[at:]]) if spans else text)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else part.column(c) for c in names], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, schema)
