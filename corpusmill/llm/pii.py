"""Personal data: exact patterns, and a semi-Markov conditional random field for what has no exact pattern.

Atoms are runs of letters and digits or single other characters. Around every digit and @ a window of atoms is labelled: a segment of up to
MAX_ATOMS atoms is one entity of one kind, with features of the whole span (its shape, digits, checksums, what stands beside
it), any other atom stands for itself. Dynamic programming over bounded segments picks boundaries and kinds together;
training maximises the conditional likelihood with the same recursion on sentences made by rule (train_sentences). The
model is trained on the driver, a few thousand weights are broadcast, and every text is searched in its own task: no
shuffle, no skew.

Spans by pattern always stay; the field adds spans that touch none of them (secrets, phone numbers without a country, ...).

Defined cases: a null or empty text has no spans; repeated rows are searched alike; whole texts are read, however long, in time that
grows with their length and with some 30 bytes for each atom near a digit; an empty table stays empty. Other columns are carried through by redact(), whatever their names.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_ATOMS, MARGIN = 15, 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its first digit only, so a long one is read once
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_ATOM = re.compile(r"[^\W_]+|[^\s]")
_HOT = re.compile(r"[0-9@]")
_DIGITS = re.compile("[0-9]+")
_NOT_GROUPED = re.compile(r"[^0-9\s().+-]")
_REPEATED = re.compile(r"([a9 ])\1+")
_LETTER = re.compile(r"[^\W\d_]")
_NO_DIGIT = {c: None for c in range(128) if not 48 <= c < 58}
_FEW = "012345"
#: ASCII digits as 9, letters as a, white space as a blank.
_SHAPE = {c: "9" if chr(c).isdigit() else "a" if chr(c).isalpha() else " " for c in range(128) if chr(c).isalnum() or chr(c).isspace()}


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, sought from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by pattern; for each kind leftmost and not overlapping, failing matches dropped."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        small = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or "0") <= 255
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


# --- the field -------------------------------------------------------------------------------------------------------


def _bucket(n: int) -> int:
    return n if n < 6 else 6 + (n > 7) + (n > 9) + (n > 11) + (n > 15) + (n > 19) + (n > 27) + (n > 39)


def _span_features(span: str) -> tuple[str, ...]:
    digits = span.translate(_NO_DIGIT) if span.isascii() else "".join(_DIGIT.findall(span))
    plain = span.translate(_SHAPE)
    shape = _REPEATED.sub(r"\1", plain if plain.isascii() else _LETTER.sub("a", re.sub(r"\s", " ", plain)))[:24]
    out = [f"shape={shape}", f"digits={_bucket(len(digits))}", f"size={_bucket(len(span))}", f"ends={span[0].isalnum():d}{span[-1].isalnum():d}"]
    if "@" in span:
        out.append(f"at={span.count('@')},{'.' in span.rpartition('@')[2]}")
    if len(digits) > 11:
        out.append(f"luhn={len(digits) < 20 and luhn(digits)},{len(digits) == len(span) - span.count(' ') - span.count('-')}")
    if span.count(".") == 3 and not span.strip("0123456789."):
        out.append(f"quad={all(len(p) < 4 and p and int(p) < 256 for p in span.split('.'))}")
    if span.isalnum() and digits and len(digits) < len(span):
        hexed = not span.lower().strip("0123456789abcdef")
        out.append(f"mixed={hexed},{_bucket(len(span))}")
    groups = _DIGITS.findall(span)
    if len(groups) > 1 and not _NOT_GROUPED.search(span):
        out.append("groups=" + "-".join([_FEW[min(len(g), 5)] for g in groups[:6]]))
    return tuple(out)


class Window:
    """Atoms of a stretch of text and its candidate segments by their end: (begin, kind, features)."""

    def __init__(self, text: str, atoms: list[tuple[int, int]]):
        self.atoms = atoms
        n = len(atoms)
        self.ends: list[list[tuple[int, int, tuple[str, ...]]]] = [[] for _ in range(n + 1)]
        words = [text[a:b] for a, b in atoms]
        hot = [bool(_HOT.search(w)) for w in words]
        for i in range(n):
            left = [w.lower() for w in words[max(0, i - 3) : i]]
            self.ends[i + 1].append((i, 0, (f"word={'9' if hot[i] else 'a' if words[i].isalnum() else words[i]}",)))
            if not (words[i].isalnum() or words[i] in "+("):
                continue
            near = f"glued={i > 0 and atoms[i - 1][1] == atoms[i][0] and words[i - 1]}"
            before = f"left={next((w for w in reversed(left) if w.isalpha()), '')}"
            mark = f"mark={''.join(w for w in left[-2:] if not w.isalnum())}"
            some = False
            for j in range(i, min(n, i + MAX_ATOMS)):
                if j > i and atoms[j][0] - atoms[j - 1][1] > 1:
                    break
                some = some or hot[j]
                if not some or not words[j].isalnum():
                    continue
                after = f"right={j + 1 < n and atoms[j + 1][0] == atoms[j][1] and words[j + 1]}"
                span = _span_features(text[atoms[i][0] : atoms[j][1]])
                for k in range(1, len(KINDS) + 1):
                    self.ends[j + 1].append((i, k, (*span, near, before, mark, after)))


class Field:
    """Weights of (kind, feature) and (kind, kind before it)."""

    def __init__(self):
        self.w: dict[tuple[int, str], float] = {}
        self._made, self._spans = None, {}

    def score(self, k: int, features: tuple[str, ...]) -> float:
        w = self.w
        return sum(w.get((k, f), 0.0) for f in features)

    def _vectors(self) -> tuple[dict[str, tuple[float, ...]], list[list[float]]]:
        """Weights by feature, a number for each kind, and those of a kind behind another."""
        m = len(KINDS) + 1
        if self._made is None:
            by: dict[str, list[float]] = {}
            for (k, f), w in self.w.items():
                by.setdefault(f, [0.0] * m)[k] = w
            self._made = {f: tuple(v) for f, v in by.items()}, [[self.w.get((k, f"<{p}"), 0.0) for p in range(m)] for k in range(m)]
        return self._made

    def best(self, text: str, atoms: array) -> list[tuple[int, int, str]]:
        """Spans (start, end, kind) of the most probable segmentation of a stretch of atoms (start, end, start, end, ...).

        The scores of the last MAX_ATOMS ends are all that the recursion looks back on; of the others two bytes for each kind are
        kept, from which the best path is read at the end. Features are made as they are needed.
        """
        vectors, turn = self._vectors()
        m, n = len(KINDS) + 1, len(atoms) // 2
        none = (0.0,) * m
        kinds = range(1, m)
        spans = self._spans

        def add(features: tuple[str, ...]) -> list[float]:
            known = [vectors[f] for f in features if f in vectors]
            return [*map(sum, zip(*known))] if known else [0.0] * m

        lengths, before = [bytearray(n + 1) for _ in range(m)], [bytearray(n + 1) for _ in range(m)]
        now = [0.0] + [-1e18] * (m - 1)
        open_: deque = deque(maxlen=MAX_ATOMS)  # (place, start in the text, score of each kind so far and the kind before it) of atoms where a segment may begin
        chain, hot_at = 0, -1
        left: deque = deque(maxlen=3)
        word, last_end = "", -2
        for j in range(n):
            a, b = atoms[2 * j], atoms[2 * j + 1]
            glued, previous = last_end == a, word
            if a - last_end > 1:
                chain = j
            word, last_end = text[a:b], b
            hot = bool(_HOT.search(word))
            hot_at = j if hot else hot_at
            plain = word.isalnum()
            came = [max((now[p] + turn[k][p], p) for p in range(m)) for k in range(m)]
            if plain or word in "+(":
                near = f"glued={j > 0 and glued and previous}"
                lead = f"left={next((w for w in reversed(left) if w.isalpha()), '')}"
                mark = f"mark={''.join(w for w in list(left)[-2:] if not w.isalnum())}"
                own = add((near, lead, mark))
                open_.append((j, a, [c[0] + o for c, o in zip(came, own)], [c[1] for c in came]))
            now = [came[0][0] + vectors.get(f"word={'9' if hot else 'a' if plain else word}", none)[0]] + [-1e18] * (m - 1)
            lengths[0][j + 1], before[0][j + 1] = 1, came[0][1]
            if plain and hot_at >= chain:
                follows = 2 * j + 2 < len(atoms) and atoms[2 * j + 2] == b
                right = add((f"right={follows and text[atoms[2 * j + 2] : atoms[2 * j + 3]]}",))
                for i, start, scores, came_from in open_:
                    if i < chain or i > hot_at or j - i >= MAX_ATOMS:
                        continue
                    span = text[start:b]
                    own = spans.get(span)
                    if own is None:
                        own = add(_span_features(span))
                        if len(span) <= 64 and len(spans) < 100_000:
                            spans[span] = own
                    for k in kinds:
                        x = scores[k] + own[k] + right[k]
                        if x > now[k]:
                            now[k] = x
                            lengths[k][j + 1], before[k][j + 1] = j + 1 - i, came_from[k]
            left.append(word.lower() if b - a <= 64 else word[:64].lower())
        j, out = n, []
        k = max(range(m), key=lambda k: now[k])
        while j > 0:
            i, p = j - lengths[k][j], before[k][j]
            if k:
                out.append((atoms[2 * i], atoms[2 * j - 1], KINDS[k - 1]))
            j, k = i, p
        return out[::-1]

    def learn(self, window: Window, truth: dict[tuple[int, int], int], rate: float) -> None:
        """One step up the conditional log likelihood of the segments {(begin, end): kind}."""
        m, n = len(KINDS) + 1, len(window.atoms)
        turn = [[self.w.get((k, f"<{p}"), 0.0) for p in range(m)] for k in range(m)]
        lse = lambda xs: (t := max(xs)) + math.log(sum(math.exp(x - t) for x in xs))
        scored = [[(i, k, f, self.score(k, f)) for i, k, f in seg] for seg in window.ends]
        alpha = [[0.0 if k == 0 else -1e9 for k in range(m)]]
        for j in range(1, n + 1):
            into: list[list[float]] = [[] for _ in range(m)]
            for i, k, _, s in scored[j]:
                into[k].append(s + lse([alpha[i][p] + turn[k][p] for p in range(m)]))
            alpha.append([lse(x) if x else -1e9 for x in into])
        beta = [[-1e9] * m for _ in range(n)] + [[0.0] * m]
        begins: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, k, _, s in scored[j]:
                begins[i].append((j, k, s))
        for i in range(n - 1, -1, -1):
            if begins[i]:
                beta[i] = [lse([s + turn[k][p] + beta[j][k] for j, k, s in begins[i]]) for p in range(m)]
        total = lse(alpha[n])
        step: dict[tuple[int, str], float] = {}
        covered = {x for a, b in truth for x in range(a, b)}
        before = 0
        for j in range(1, n + 1):
            for i, k, f, s in scored[j]:
                for p in range(m):
                    expected = math.exp(min(0.0, alpha[i][p] + turn[k][p] + s + beta[j][k] - total))
                    if expected > 1e-6:
                        step[k, f"<{p}"] = step.get((k, f"<{p}"), 0.0) - expected
                        for x in f:
                            step[k, x] = step.get((k, x), 0.0) - expected
                true = truth.get((i, j)) == k if k else i not in covered
                if true:
                    for x in f:
                        step[k, x] = step.get((k, x), 0.0) + 1
                    step[k, f"<{before}"] = step.get((k, f"<{before}"), 0.0) + 1
                    before = k
        for key, g in step.items():
            self.w[key] = self.w.get(key, 0.0) * (1 - 1e-4) + rate * g
        self._made, self._spans = None, {}


def train_sentences(n: int = 420, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences by rule with their entities: words that say nothing around personal data and look-alikes."""
    r = random.Random(seed)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st le is ou ar as de ve la al".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        while True:
            d = r.choice("3456") + digits(15)
            if luhn(d):
                return r.choice((d, d, "-".join(d[i : i + 4] for i in (0, 4, 8, 12)), " ".join(d[i : i + 4] for i in (0, 4, 8, 12))))

    def plain() -> str:
        while True:
            d = digits(16)
            if not luhn(d):
                return d

    makers = {
        "email": lambda: r.choice((f"{word()}.{digits(2)}@mail{digits(1)}.example.com", f"{word()}@{word()}.org", f"{word()}_{word()}@{word()}.{word()}.net", f"{word()}{digits(2)}@{word()}.com")),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice((f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}")),
        "secret": lambda: r.choice((hexes(40), hexes(32), hexes(64), "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(36)))),
    }
    other = (
        lambda: str(r.randint(0, 99)), lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 99)}.{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}", lambda: f"{r.randint(1, 99)}%", plain, lambda: digits(6), lambda: f"{r.randint(1, 9)},{digits(3)},{digits(3)}", lambda: f"@{word()}", lambda: f"{word()}{digits(2)}", lambda: f"({digits(4)})",
        lambda: f"300.{digits(3)}.999.{digits(3)}", lambda: hexes(8), lambda: f"{digits(1)}-{digits(1)}", lambda: f"/{word()}/{digits(4)}",
    )
    out = []
    for i in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(1, 4))), []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.62:
                kind = KINDS[(i + len(spans)) % len(KINDS)]
                lead = {"secret": r.choice(('token = "', "api_key: ", "password=", "secret = '", " ")), "phone": r.choice(("", "", "call ", "tel. "))}.get(kind, "")
                text += r.choice((" ", " ", ". ", ", ")) + lead
                value = makers[kind]()
                spans.append((len(text), len(text) + len(value), kind))
                text += value + ('"' if lead.endswith('"') else "'" if lead.endswith("'") else r.choice(("", "", "###", ",", ".")))
            else:
                text += " " + r.choice(other)()
            text += " " + " ".join(word() for _ in range(r.randint(1, 3)))
        out.append((text, spans))
    return out


def windows(text: str) -> Iterator[array]:
    """Stretches of atoms (start, end, start, end, ...) within MARGIN of one with a digit or @."""
    at = 0
    while m := _HOT.search(text, at):
        # atoms begin anew near the next digit: far enough back for MARGIN atoms
        back = m.start()
        for _ in range(MARGIN + 1):
            back = max(at, text.rfind(" ", at, back))
            if back <= at:
                break
        stretch, recent = array("q"), deque(maxlen=MARGIN)
        quiet, end = 0, len(text)
        for a in _ATOM.finditer(text, back):
            span = a.span()
            if _HOT.search(text, *span):
                for x in recent:
                    stretch.extend(x)
                stretch.extend(span)
                recent, quiet = deque(maxlen=2 * MARGIN), 0
            else:
                recent.append(span)
                quiet += 1
                if stretch and quiet >= 2 * MARGIN:
                    end = span[1]
                    break
        for x in list(recent)[:MARGIN]:
            stretch.extend(x)
        yield stretch
        at = end


@lru_cache(maxsize=4)
def train(n: int = 420, rounds: int = 6, seed: int = 11) -> Field:
    field = Field()
    examples = []
    for text, spans in train_sentences(n, seed):
        w = Window(text, [m.span() for m in _ATOM.finditer(text)])
        begin, end = {a: i for i, (a, _) in enumerate(w.atoms)}, {b: i + 1 for i, (_, b) in enumerate(w.atoms)}
        examples.append((w, {(begin[a], end[b]): KINDS.index(k) + 1 for a, b, k in spans}))
    for k in range(rounds):
        random.Random(k).shuffle(examples)
        for w, truth in examples:
            field.learn(w, truth, 0.3 / (1 + k))
    return field


def find(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans by pattern, and all spans, each by start and then kind as listed. Places count code points."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    if not _HOT.search(text):
        return base, base
    extra = []
    taken = sorted((a, b) for a, b, _ in base)
    for w in windows(text):
        for s in field.best(text, w):
            if not any(a < s[1] and s[0] < b for a, b in _near(taken, s)):
                extra.append(s)
    return base, sorted([*base, *extra], key=order)


def _near(taken: list[tuple[int, int]], span) -> list[tuple[int, int]]:
    import bisect

    i = bisect.bisect_left(taken, (span[1],))
    return taken[max(0, i - 8) : i]  # spans of a kind don't overlap: of each of the kinds the last two at most reach it


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find_pii(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with the new columns `base` and `spans`: arrays of (start, end, kind)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    names = [fresh("base", docs), fresh("spans", docs)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        as_dicts = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for batch in batches:
            found = [find(t or "", known) for t in batch.column(at).to_pylist()]
            columns = [pa.array([as_dicts(f[k]) for f in found], _SPAN) for k in (0, 1)]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "base", "spans"])

    numbered = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"
    ddl = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)), f"base {kind}", f"spans {kind}"])
    out = numbered.mapInArrow(run, ddl)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), *(F.col(o).alias(n) for o, n in zip(("base", "spans"), names)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; of overlapping spans the first to start counts."""
    spans = fresh("spans", docs)
    found = find_pii(docs, text_col)
    start = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(F.concat(a["t"], F.substr(F.col(text_col), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("t"), s["end"].alias("at"))
    )
    text = F.aggregate(spans, start, step, lambda a: F.concat(a["t"], F.substr(F.col(text_col), a["at"] + 1)))
    return found.select(*(F.when(F.size(spans) > 0, text).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op10_pii(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
