"""Personal data: base patterns, and spans of a linear-chain CRF over word-shape features.

The base rule finds emails, IP addresses, card and phone numbers by pattern. The CRF, trained in
numpy from the small labelled table that ``labelled_table`` builds, tags words as part of an email,
address, card, phone or secret by their shapes and their neighbours' shapes, so it also finds
secrets (``token = "..."``) and numbers that the patterns miss. Its spans are added where they
don't touch a base span; base spans stay.

Decoding is exact Viterbi over whole lines, many lines at a time in numpy: lines of all lengths advance
together, so a long one costs its own words. Scores of a word depend on its shape only, so they are kept per shape in a
bounded table of the task.

Cases: null and empty texts have no spans, counts 0 and the digest of ''; offsets count code
points, ends are exclusive; repeated rows are scanned one by one; time and memory grow
with a text's length, not its square.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from folioscan.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("email", "ip", "card", "phone", "secret")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = bytes.maketrans(b"", b""), bytes(sorted(set(range(256)) - set(b"0123456789")))


def _digits(text: bytes) -> bytes:
    return text.translate(*_DIGITS)


def luhn(digits: bytes) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: bytes) -> dict[str, list[tuple[int, int]]]:
    """Byte spans of each kind, leftmost and non-overlapping within the kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if b"@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            # The match starts where the run of local-part characters before the sign does.
            begin = m.start()
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < m.start():
                found["email"].append((begin, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 9 else int(p.lstrip(b"0")[:9] or 0) <= 255 for p in m.group().split(b".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                found["phone"].append(m.span())
    return found


# --- shapes -------------------------------------------------------------------------------------

_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256)
)
#: Words that the features name as such.
CUES = frozenset(b"token key secret password passwd api_key apikey = : call phone tel mail email card visa ip host from".split())
_RUN = re.compile(rb"(.)\1+")


def shape(word: bytes) -> bytes:
    """Cue words as they are; else letters as a or A, digits as 9, other bytes unchanged."""
    low = word.lower()
    return b"=" + low if low in CUES else word.translate(_SHAPE)


def features(s: bytes) -> list[str]:
    """Names of what a shape shows of a word."""
    if s[:1] == b"=" and s[1:] in CUES:
        return ["cue:" + s[1:].decode()]
    digits, letters = s.count(b"9"), s.count(b"a") + s.count(b"A")
    short = _RUN.sub(rb"\1", s)[:14].decode("latin-1")
    out = [f"s:{short}", f"d:{min(digits, 20) if digits < 4 or digits in (15, 16) else digits // 4 * 4 if digits < 24 else 24}"]
    out.append(f"l:{0 if not letters else 1 if letters < 4 else 2 if letters < 16 else 3}")
    if digits and letters and len(s) >= 16:
        out.append("mixed")
    if b"@" in s:
        out.append("at." if b"." in s[s.find(b"@") :] else "at")
    if s[:1] == b"+":
        out.append("plus")
    if s[:1] == b"(" and digits:
        out.append("paren")
    if s.count(b".") >= 3 and digits >= 4 and not letters:
        out.append("quad")
    if digits and b"-" in s:
        out.append("dash")
    if not digits and b"@" not in s:
        out.append("plain")
    return out


def near(s: bytes) -> list[str]:
    """What a neighbour is told: less than a word knows of itself."""
    return [f for f in features(s) if f[0] in "cd" or f in ("plus", "paren", "mixed", "plain", "dash")]


def labelled_table(rows: int = 480, seed: int = 5) -> list[list[tuple[bytes, str]]]:
    """The labelled lines: invented words with entities and look-alikes, tagged per word."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    letters = lambda n: "".join(chr(97 + int(rng.integers(26))) for _ in range(n))
    num = lambda n: "".join(str(int(rng.integers(10))) for _ in range(n))
    hexa = lambda n: "".join("0123456789abcdef"[int(rng.integers(16))] for _ in range(n))

    def prose(n: int) -> list[tuple[str, str]]:
        out = []
        for _ in range(n):
            w = letters(int(rng.integers(1, 14)))
            kind = rng.random()
            w = w.capitalize() if kind < 0.1 else w.upper() if kind < 0.15 else w
            w += pick("", "", "", "", "", "", ",", ".", "!!", "&&&", "***", "###", "%%%", "$$$")
            out.append((w, "O"))
        return out

    def entity() -> list[tuple[str, str]]:
        end = pick("", "", "", ".", ",", "###")
        kind = int(rng.integers(9))
        if kind == 0:
            name = pick(letters(6), letters(5) + "." + letters(4), letters(3) + "." + num(2))
            return [(f"{name}@{letters(5)}{pick('', num(1))}.{pick('example.com', 'org', 'net')}{end}", "B-email")]
        if kind == 1:
            return [(".".join(str(int(rng.integers(1, 256))) for _ in range(4)) + end, "B-ip")]
        if kind == 2:
            if rng.random() < 0.6:
                return [(num(16) + end, "B-card")]
            return [(num(4), "B-card"), (num(4), "I-card"), (num(4), "I-card"), (num(4) + end, "I-card")]
        if kind == 3:
            if rng.random() < 0.7:
                return [("+" + num(int(rng.integers(1, 3))), "B-phone"), (f"({num(3)})", "I-phone"), (f"{num(3)}-{num(4)}{end}", "I-phone")]
            return [(f"({num(3)})", "B-phone"), (f"{num(3)}-{num(4)}{end}", "I-phone")]
        if kind == 4:
            return [(f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}{end}", "B-phone")]
        if kind in (5, 6):
            cue = pick("token", "secret", "key", "password", "api_key")
            return [(cue, "O"), (pick("=", ":"), "O"), (f'"{hexa(pick(32, 40))}"{end}', "B-secret")]
        if kind == 7:
            return [(pick(num(4), num(2), num(4) + "-" + num(2) + "-" + num(2), "v" + num(1) + "." + num(1), num(3) + "," + num(3)) + end, "O")]
        return [(pick("token", "key", "card", "phone", "from"), "O"), *prose(2)]

    out = []
    for i in range(rows):
        line = prose(int(rng.integers(0, 8)))
        for _ in range(i % 4):
            line += entity() + prose(int(rng.integers(0, 6)))
        if line:
            out.append([(w.encode(), t) for w, t in line])
    return out


LABELS = ["O"] + [f"{p}-{k}" for k in EXTRA for p in "BI"]
#: I-x may follow B-x and I-x only.
ALLOWED = np.array([[b[0] != "I" or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])


class CRF:
    """Weights by feature name and the transitions between labels."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))

    def row(self, prefix: str, names: list[str], grow: bool = False) -> list[int]:
        keys = [prefix + n for n in names]
        if grow:
            for k in keys:
                self.index.setdefault(k, len(self.index))
        return [self.index[k] for k in keys if k in self.index]

    def fit(self, table: list[list[tuple[bytes, str]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-4) -> CRF:
        """Adam on the conditional log-likelihood of all lines at once."""
        shapes = [[shape(w) for w, _ in line] for line in table]
        rows = []
        for line in shapes:
            for i, s in enumerate(line):
                r = self.row("", features(s), True)
                r += self.row("<", near(line[i - 1]) if i else ["edge"], True)
                r += self.row(">", near(line[i + 1]) if i + 1 < len(line) else ["edge"], True)
                rows.append(r)
        flat = np.concatenate([np.array(r) for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        n, longest = len(table), max(map(len, table))
        place = np.full((n, longest), -1)
        at = 0
        for i, line in enumerate(table):
            place[i, : len(line)] = np.arange(at, at + len(line))
            at += len(line)
        gold = np.array([LABELS.index(t) for line in table for _, t in line])
        size = len(LABELS)
        self.weights = np.zeros((len(self.index), size))
        floor = np.where(ALLOWED, 0.0, -1e4)
        m = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        v = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for step in range(1, steps + 1):
            emit = np.zeros((len(rows), size))
            np.add.at(emit, of, self.weights[flat])
            moves = self.moves + floor
            live = place >= 0
            e = emit[np.maximum(place, 0)]
            a = np.zeros((n, longest, size))
            b = np.zeros((n, longest, size))
            a[:, 0] = e[:, 0]
            lse = lambda x, axis: np.log(np.exp(x - (t := x.max(axis, keepdims=True))).sum(axis)) + t.squeeze(axis)
            for t in range(1, longest):
                new = lse(a[:, t - 1][:, :, None] + moves, 1) + e[:, t]
                a[:, t] = np.where(live[:, t][:, None], new, a[:, t - 1])
            z = lse(a[:, -1], 1)
            for t in range(longest - 2, -1, -1):
                new = lse(moves[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
                b[:, t] = np.where(live[:, t + 1][:, None], new, 0)
            p = np.exp(a + b - z[:, None, None])
            ge = np.zeros_like(emit)
            ge[place[live]] = p[live]
            ge[np.arange(len(rows)), gold] -= 1
            gw = np.zeros_like(self.weights)
            np.add.at(gw, flat, ge[of])
            gm = np.zeros_like(self.moves)
            for t in range(1, longest):
                both = live[:, t]
                q = a[both, t - 1][:, :, None] + moves + (e[both, t] + b[both, t])[:, None, :] - z[both][:, None, None]
                gm += np.exp(q).sum(0)
                np.subtract.at(gm, (gold[place[both, t - 1]], gold[place[both, t]]), 1)
            for k, (w, g) in enumerate(((self.weights, gw), (self.moves, gm))):
                g = g / n + decay * w
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def sums(self, s: bytes) -> np.ndarray:
        """A shape's scores for itself, as left and as right neighbour."""
        w = self.weights
        parts = (("", features(s)), ("<", near(s)), (">", near(s)))
        return np.stack([w[r].sum(0) if (r := self.row(p, f)) else np.zeros(len(LABELS)) for p, f in parts])

    def edge(self, prefix: str) -> np.ndarray:
        r = self.row(prefix, ["edge"])
        return self.weights[r].sum(0) if r else np.zeros(len(LABELS))


def viterbi(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of all chains at once; rows of ``emit`` are the words of the chains one after the other."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]
    out = np.zeros(len(emit), np.int8)
    if not longest:
        return out
    score = emit[starts]
    back = []
    for t in range(1, longest):
        n = live[t]
        through = score[:n, :, None] + moves
        best = through.argmax(1)
        score[:n] = np.take_along_axis(through, best[:, None], 1)[:, 0] + emit[starts[:n] + t]
        back.append(best.astype(np.int8))
    label = score.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        out[starts[:n] + t] = label[:n]
        if t:
            label[:n] = back[t - 1][np.arange(n), label[:n]]
    return out


class Tagger:
    """Decodes batches of texts with a table of scores by shape."""

    TABLE = 1 << 16

    def __init__(self, crf: CRF):
        self.crf = crf
        self.moves = (crf.moves + np.where(ALLOWED, 0.0, -1e4)).astype(np.float32)
        self.left, self.right = crf.edge("<").astype(np.float32), crf.edge(">").astype(np.float32)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((self.TABLE, 3, len(LABELS)), np.float32)
        # I-labels can't open a chain.
        self.open = np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], np.float32)

    def _id(self, s: bytes) -> int:
        at = self.known.get(s)
        if at is None:
            at = self.known[s] = len(self.known)
            self.scores[at] = self.crf.sums(s)
        return at

    def tags(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Labels of all words of all texts, and where each text's words start."""
        words: list[bytes] = []
        lengths: list[int] = []
        bounds = [0]
        for text in texts:
            for line in text.split(b"\n"):
                if w := line.split():
                    words += w
                    lengths.append(len(w))
            bounds.append(len(words))
        if not words:
            return np.zeros(0, np.int8), np.array(bounds)
        translate, cues = _SHAPE, CUES
        shapes = [w.translate(translate) for w in words]
        shapes = [b"=" + w.lower() if w.lower() in cues else s for w, s in zip(words, shapes)]
        if len(self.known) + len(fresh := {s for s in shapes if s not in self.known}) > self.TABLE:
            self._reset()
            if len(fresh := set(shapes)) > self.TABLE:
                half = len(texts) // 2
                if half:
                    a, b = self.tags(texts[:half]), self.tags(texts[half:])
                    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1][1:] + a[1][-1]])
                self.TABLE = len(fresh)  # one text alone has more shapes; the table is as large as the text
                self._reset()
        for s in fresh:
            self._id(s)
        known = self.known
        ids = np.fromiter((known[s] for s in shapes), np.int64, len(shapes))
        size = np.array(lengths)
        starts = np.cumsum(size) - size
        emit = self.scores[ids, 0]
        first = np.zeros(len(ids), bool)
        first[starts] = True
        last = np.zeros(len(ids), bool)
        last[starts + size - 1] = True
        emit[1:] += np.where(first[1:, None], self.left, self.scores[ids[:-1], 1])
        emit[:-1] += np.where(last[:-1, None], self.right, self.scores[ids[1:], 2])
        emit[0] += self.left
        emit[-1] += self.right
        emit[starts] += self.open
        return viterbi(emit, starts, size, self.moves), np.array(bounds)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CORE = {
    "email": re.compile(rb"[^@\s]+@[^@\s]*[A-Za-z0-9]"),
    "ip": re.compile(rb"[0-9][0-9.]*[0-9]"),
    "card": re.compile(rb"[0-9][0-9 -]*[0-9]"),
    "phone": re.compile(rb"[+(]?[0-9][0-9 ().-]*[0-9]"),
    "secret": re.compile(rb"[A-Za-z0-9_-]{16,}"),
}
_LEAST = {"email": 0, "ip": 4, "card": 13, "phone": 7, "secret": 1}


def added_spans(text: bytes, labels: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Byte spans of the tagged words that touch no base span."""
    out: list[tuple[str, int, int]] = []
    places = [m.span() for m in _WORD.finditer(text)]
    i = 0
    while i < len(labels):
        name = LABELS[labels[i]]
        j = i + 1
        if name != "O":
            while j < len(labels) and LABELS[labels[j]] == "I-" + name[2:]:
                j += 1
            lo, hi = places[i][0], places[j - 1][1]
            kind = name[2:]
            m = _CORE[kind].search(text[lo:hi])
            plausible = m and len(_digits(m.group())) >= _LEAST[kind]
            if plausible and (kind != "card" or luhn(_digits(m.group()))):
                b, e = lo + m.start(), lo + m.end()
                # ``taken`` is sorted and free of overlaps: only the spans around ``b`` can meet it.
                at = bisect_right(taken, (b, len(text)))
                if (not at or taken[at - 1][1] <= b) and (at == len(taken) or e <= taken[at][0]):
                    out.append((kind, b, e))
        i = j
    return out


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def scan(texts: list[bytes], tagger: Tagger) -> dict[str, list]:
    """Counts, digest and spans of each text."""
    tags, bounds = tagger.tags(texts)
    marked = np.concatenate(([0], np.cumsum(tags != 0)))
    out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
    for i, text in enumerate(texts):
        base = base_spans(text)
        lo, hi = bounds[i], bounds[i + 1]
        taken = [x for k in KINDS for x in base[k]]
        extra = added_spans(text, tags[lo:hi], merged_spans(taken)) if marked[hi] > marked[lo] else []
        if text.isascii() or not (taken or extra):
            chars = int
        else:
            # Code points before each byte, in one pass over the text.
            before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
            chars = before.__getitem__
        if taken or extra:
            base_text = [f"{k}:{chars(b)}:{chars(e)}" for k in KINDS for b, e in base[k]]
            merged = {k: sorted([*base.get(k, []), *((b, e) for x, b, e in extra if x == k)]) for k in EXTRA}
            all_text = [f"{k}:{chars(b)}:{chars(e)}" for k in EXTRA for b, e in merged[k]]
        else:
            base_text = all_text = []
        for k in KINDS:
            out["n_" + k].append(len(base[k]))
        out["base_sha256"].append(sha256(",".join(base_text).encode()).hexdigest())
        out["spans"].append(",".join(all_text))
    return out


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), table=None) -> DataFrame:
    """``keep`` columns with n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    crf = CRF().fit(table or labelled_table())

    def setup():
        tagger = Tagger(crf)
        return lambda texts, _: scan(texts, tagger)

    return map_texts(
        docs, list(keep), setup,
        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )
