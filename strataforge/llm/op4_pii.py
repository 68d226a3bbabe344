"""Personal data: fixed base patterns, and a semi-Markov conditional random field beside them.

Base spans are the contract's four patterns over the whole text. The model adds spans that
the patterns miss (phones without a plus, spelled-out addresses, secrets, IBANs, identity
numbers): segments of up to MAX_TOKENS tokens and MAX_CHARS characters are scored as wholes (their shape,
digits, entropy, the checksums of IBANs and cards, the words before them), and a dynamic program over
segment ends chooses boundaries and types together. The bounds are those of the kinds: the longest IBAN
has nine groups, and a spelled-out address, whose labels are not bounded, is followed label by
label beyond its segment. Decoding runs over windows around triggers (digits, `@`, `=`, spelled-out at and
dot, cue words), at any place of the text; its cost is linear in their number. Training maximises the conditional likelihood of labelled
sequences by forward-backward over segments.

Defined cases: a null or empty text has no spans (the digest of the empty string); a model
span that overlaps a base span is left out; repeated rows are treated each by itself; an empty
table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.llm._common import arrow_rows, ship, table

BASE_KINDS = ("email", "ip", "card", "phone")
MODEL_KINDS = ("email", "phone", "secret", "iban", "ssn")
#: The longest IBANs are 34 characters in groups of four. Segments of several tokens have at most MAX_CHARS
#: characters, as an address has; single tokens may be of any length.
MAX_TOKENS, MAX_CHARS = 9, 320
#: Characters of the account part by country, for training.
IBAN_LENGTHS = {"NO": 11, "BE": 12, "NL": 14, "DE": 18, "GB": 18, "ES": 20, "FR": 23, "IT": 23, "PL": 24, "MT": 27, "LC": 28}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Matches start at the start of a run of digits; said so, a long run is looked at once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each `@`: the local part is the run of its characters before it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            floor = m.end()
            out.append((start, floor))
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed. Matches that fail their check are dropped, not retried."""
    found = [(s, e, 0) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = only_digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, BASE_KINDS[k]) for s, e, k in found]


def span_list(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# ---- whole-span features ------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&="
#: Cue words that stand before a span, by the kind they speak for. Fixed values.
CUES = {
    "email": frozenset("email e-mail mail contact".split()),
    "phone": frozenset("phone tel telephone call mobile fax telefon telefono cell".split()),
    "secret": frozenset("token password passwd secret key api_key apikey pwd auth bearer access_key".split()),
    "iban": frozenset("iban account konto cuenta compte".split()),
    "ssn": frozenset("ssn social security tax passport".split()),
}
_CUE = r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, frozenset().union(*CUES.values())), key=lambda w: (-len(w), w))) + r")(?![^\W_])"
_TRIGGER = re.compile(r"[0-9@=]|\((?:at|dot)\)|\[(?:at|dot)\]|" + _CUE, re.I)
_SHAPES = {
    "phone": re.compile(r"(?:\(?[0-9]{2,4}\)?[ .-]){1,3}[0-9]{3,4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "email": re.compile(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)+", re.I),
    "secret": re.compile(r"(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])[A-Za-z0-9+/_-]{16,}=*"),
}
#: A spelled-out dot on either side of a segment, which then is part of a longer address.
_DOT_AFTER, _DOT_BEFORE = re.compile(r"\s*(?:\(dot\)|\[dot\])", re.I), re.compile(r"(?:\(dot\)|\[dot\])\s*$", re.I)
#: Labels of a spelled-out address behind a segment.
_MORE_LABELS = re.compile(r"(?:\s*(?:\(dot\)|\[dot\])\s*[\w-]+)+", re.I)
N_FEATURES = 27


def entropy(s: str) -> float:
    n = len(s)
    return -sum((k := s.count(c) / n) * math.log2(k) for c in set(s)) if n else 0.0


def iban_checks(s: str) -> bool:
    """Whether the check digits of a compact form are right (the remainder by 97 is 1)."""
    c = s.replace(" ", "")
    if not (15 <= len(c) <= 34 and c.isascii() and c.isalnum() and c[:2].isalpha() and c[2:4].isdigit()):
        return False
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Span without the punctuation around it; a bracket that opens a phone number stays, as a `key=` goes."""
    eq = text.rfind("=", start, end)
    if start <= eq < end - 1 and text[eq + 1 : eq + 2].strip("=\"' "):
        start = eq + 1
    elif start <= eq < end - 2 and text[eq + 1] in "\"'":
        start = eq + 2
    closing = text.rfind(")", start, end)
    while start < end and text[start] in _EDGE and not (text[start] == "(" and closing >= start):
        start += 1
    opening = text.find("(", start, end)
    while start < end and text[end - 1] in _EDGE and not (text[end - 1] == ")" and start <= opening < end):
        end -= 1
    return start, end


_CUE_KINDS = {w: [i for i, k in enumerate(CUES) if w in CUES[k]] for w in frozenset().union(*CUES.values())}
_AT = ("@", "(at)", "[at]")
#: What a segment of several tokens has to hold.
_MARK = re.compile(r"[0-9@]|\((?:at|dot)\)|\[(?:at|dot)\]", re.I)


def features(text: str, start: int, end: int, length: int, before: list[str]) -> list[float]:
    """Features of a whole segment: text[start:end] trimmed, its number of tokens, the lower-cased words before it."""
    f = [0.0] * N_FEATURES
    s = text[start:end]
    f[0] = 1.0
    f[1] = length > 1
    f[2] = length > 2
    if not s:
        return f
    n = len(s)
    digits = sum(map(s.count, "0123456789"))
    alpha = sum(map(str.isalpha, s))
    f[3] = digits > 0
    f[4] = digits / n
    f[5] = 7 <= digits <= 15 and not alpha
    f[6] = digits == n and n > 4
    if n >= 16 and " " not in s:
        f[7] = 1.0
        f[8] = entropy(s) > 3.0
    f[9] = alpha > 0 and digits > 0
    low = s.lower()
    f[10] = any(x in low for x in _AT)
    f[11] = alpha == 0
    for i, kind in enumerate(MODEL_KINDS):
        f[12 + i] = _SHAPES[kind].fullmatch(s) is not None
    for w in before[-2:]:
        for i in _CUE_KINDS.get(w, ()):
            f[17 + i] = 1.0
    f[22] = digits == 0 and s[:4].isalpha()
    f[23] = start > 0 and text[start - 1] in "\"'="
    f[24] = bool(_DOT_AFTER.match(text, end, end + 16) or _DOT_BEFORE.search(text, max(0, start - 16), start))
    f[25] = 15 <= n <= 64 and digits > 1 and iban_checks(s)
    f[26] = 12 <= digits <= 19 and not alpha and luhn(only_digits(s))
    return f


#: Tokens of a window whose segments are scored at a time.
BLOCK_TOKENS = 1024


class SpanModel:
    """Weights [kind, feature]; kind 0 is outside (segments of one token), others follow MODEL_KINDS."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros((1 + len(MODEL_KINDS), N_FEATURES)) if weights is None else weights

    def lattice(self, text: str, tokens: list[tuple[int, int]], first: int = 0, last: int | None = None):
        """For each end j in (first, last] and length d: trimmed span and its features."""
        last = len(tokens) if last is None else last
        low = max(0, first - MAX_TOKENS - 3)
        lows = [text[s:e].lower().strip(_EDGE) for s, e in tokens[low:last]]
        marks = np.cumsum([0] + [_MARK.search(text, s, e) is not None for s, e in tokens[low:last]]).tolist()
        cells = []
        for j in range(first + 1, last + 1):
            for d in range(1, min(MAX_TOKENS, j) + 1):
                i = j - d
                if d > 1:
                    if tokens[j - 1][1] - tokens[i][0] > MAX_CHARS:
                        break
                    if marks[j - low] == marks[i - low]:
                        continue
                a, b = trimmed(text, tokens[i][0], tokens[j - 1][1])
                inside = lows[i - low : i - low + 1] if "=" in text[tokens[i][0] : a] else []
                before = lows[max(0, i - low - 2) : i - low] + [w.split("=")[0].strip("\"': ") for w in inside]
                if before and before[-1] == "" and i - low >= 3:
                    before = lows[i - low - 3 : i - low]
                cells.append((j, d, a, b, features(text, a, b, d, before)))
        return cells

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """Best segmentation: V[j] = max over lengths and kinds of V[j - d] + score. Features are held for BLOCK_TOKENS tokens at a time."""
        best, back = [0.0] + [-math.inf] * len(tokens), [None] * (len(tokens) + 1)
        for first in range(0, len(tokens), BLOCK_TOKENS):
            cells = self.lattice(text, tokens, first, min(len(tokens), first + BLOCK_TOKENS))
            scores = (np.array([c[4] for c in cells], dtype=float) @ self.w.T).tolist()
            for (j, d, a, b, _), row in zip(cells, scores):
                base = best[j - d]
                for k, v in enumerate(row):
                    if base + v > best[j] and (k or d == 1):
                        best[j], back[j] = base + v, (d, k, a, b)
        out, j = [], len(tokens)
        while j:
            d, k, a, b = back[j]
            if k and b > a:
                out.append((a, b, MODEL_KINDS[k - 1]))
            j -= d
        return out[::-1]

    def gradient(self, text: str, tokens, gold: list[tuple[int, int, str]]) -> np.ndarray:
        """Gradient of log p(gold | text): features of the gold segments less their expectation."""
        cells = self.lattice(text, tokens)
        x = np.array([c[4] for c in cells], dtype=float)
        scores = x @ self.w.T
        n = len(tokens)
        for c, row in zip(cells, scores):
            if c[1] > 1:
                row[0] = -np.inf
        seg = np.logaddexp.reduce(scores, axis=1)
        fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fwd[0] = bwd[n] = 0.0
        for (j, d, *_), v in zip(cells, seg):
            fwd[j] = np.logaddexp(fwd[j], fwd[j - d] + v)
        for (j, d, *_), v in zip(reversed(cells), seg[::-1]):
            bwd[j - d] = np.logaddexp(bwd[j - d], v + bwd[j])
        grad = np.zeros_like(self.w)
        for (j, d, *_), row, f in zip(cells, scores, x):
            grad -= np.outer(np.exp(row + fwd[j - d] + bwd[j] - fwd[n]), np.array(f, dtype=float))
        starts = {s: i for i, (s, _) in enumerate(tokens)}
        covered = set()
        by = {(c[0], c[1]): np.array(c[4], dtype=float) for c in cells}
        for s, e, kind in gold:
            i = starts[s]
            j = next(t for t in range(i + 1, n + 1) if tokens[t - 1][1] >= e)
            covered |= set(range(i, j))
            grad[1 + MODEL_KINDS.index(kind)] += by[j, j - i]
        for i in range(n):
            if i not in covered:
                grad[0] += by[i + 1, 1]
        return grad


def training_set(seed: int = 7, size: int = 240) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled sequences: invented words, spans of each kind with and without cues, and look-alikes outside."""
    rnd = random.Random(seed)
    digit = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("aeioutrnsldhm") for _ in range(rnd.randint(2, 9)))

    def iban() -> str:
        country = rnd.choice(sorted(IBAN_LENGTHS))
        head = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) if country in ("GB", "NL", "MT", "LC") else digit(4)
        account = head + digit(IBAN_LENGTHS[country] - 4)
        check = 98 - int("".join(str(int(x, 36)) for x in account + country + "00")) % 97
        s = f"{country}{check:02d}{account}" if rnd.random() < 0.8 else f"{country}{digit(2)}{account}"
        return s if rnd.random() < 0.3 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    make = {
        "phone": lambda: rnd.choice([f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"0{digit(2)} {digit(3)} {digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}"]),
        "email": lambda: rnd.choice([f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}[dot]org", f"{word()}@{word()}.com", f"{word()} (at) {word()} (dot) {word()} (dot) com", f"{word()} [at] {word()} [dot] {word()} [dot] {word()} [dot] org"]),
        "secret": lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice((32, 40, 24)))) if rnd.random() < 0.7 else "".join(rnd.choice("abcdefghijABCDEFGHIJ0123456789") for _ in range(28)) + "7a",
        "iban": iban,
        "ssn": lambda: f"{digit(3)}-{digit(2)}-{digit(4)}",
    }
    cue = {k: sorted(v) for k, v in CUES.items()}
    out = []
    for _ in range(size):
        text, gold = "", []
        for _ in range(rnd.randint(2, 5)):
            text += word() + " "
        roll = rnd.random()
        if roll < 0.62:
            kind = rnd.choice(MODEL_KINDS)
            if rnd.random() < 0.7:
                text += rnd.choice(cue[kind]) + rnd.choice([" ", ": ", " = "])
            quote = '"' if kind == "secret" and rnd.random() < 0.5 else ""
            s = make[kind]()
            gold.append((len(text), len(text) + len(s) + 2 * len(quote), kind))
            text += quote + s + quote + " "
        else:
            text += rnd.choice([digit(rnd.randint(1, 5)), f"{digit(4)}-{digit(2)}-{digit(2)}", f"{digit(2)}:{digit(2)}", f"v{digit(1)}.{digit(1)}.{digit(2)}", f"{digit(3)} {digit(2)}", f"x = {digit(2)}", f"{word()}{digit(2)}", f"{word()}{word()}{word()}{digit(1)}x", f"${digit(3)}.{digit(2)}", digit(8), f"{word()} = {word()}"]) + " "
        for _ in range(rnd.randint(1, 4)):
            text += word() + " "
        out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def default_model() -> SpanModel:
    return train(training_set())


def train(rows, epochs: int = 5, rate: float = 0.3, l2: float = 1e-4) -> SpanModel:
    """Stochastic gradient ascent in a fixed order with AdaGrad steps."""
    model = SpanModel()
    seen = np.full_like(model.w, 1e-3)
    for _ in range(epochs):
        for text, gold in rows:
            g = model.gradient(text, [m.span() for m in _TOKEN.finditer(text)], gold) - l2 * model.w
            seen += g * g
            model.w += rate * g / np.sqrt(seen)
    return model


def windows(text: str, around: int = MAX_TOKENS - 1):
    """Token lists around triggers: each trigger's token with `around` tokens on either side, merged where they meet.

    So a window holds every segment of up to MAX_TOKENS tokens that has a trigger.
    """
    m = _TRIGGER.search(text)
    while m:
        start = m.start()
        for _ in range(around + 1):  # to the start of the token, then back by whole tokens
            while start > 0 and not text[start - 1].isspace():
                start -= 1
            lead = start
            while lead > 0 and text[lead - 1].isspace():
                lead -= 1
            if lead == 0:
                break
            start = lead
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        tokens, last = [], m.end()
        quiet = 0
        for t in _TOKEN.finditer(text, start):
            tokens.append(t.span())
            last = t.end()
            if t.end() > m.start():
                quiet = 0 if _TRIGGER.search(text, t.start(), t.end()) else quiet + 1
                if quiet >= around:
                    break
        yield tokens
        m = _TRIGGER.search(text, max(last, m.end()))


def all_spans(text: str, model: SpanModel) -> tuple[list, list]:
    """(base spans, base and model spans by start)."""
    base = base_spans(text)
    spans = list(base)
    kinds = {k: i for i, k in enumerate((*BASE_KINDS, *MODEL_KINDS))}
    taken = sorted((s, e) for s, e, _ in base)
    found = [x for tokens in windows(text) for x in model.decode(text, tokens)]
    found = [(s, m.end() if k == "email" and (m := _MORE_LABELS.match(text, e)) else e, k) for s, e, k in found]
    i, last = 0, -1
    for s, e, k in sorted(found):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and not any(a < e and b > s for a, b in taken[max(0, i - 2) : i + 4]):
            spans.append((s, e, k))
            last = e
    spans.sort(key=lambda x: (x[0], kinds[x[2]]))
    return base, spans


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """id, base: array of (start, end, kind), spans: the same with the model's. A map without shuffle."""
    model = model or default_model()
    ship(df.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("base", span), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, spans = [], []
        for t in batch.column(1):
            a, b = all_spans(t.as_py() or "", model)
            base.append([{"start": s, "end": e, "kind": k} for s, e, k in a])
            spans.append([{"start": s, "end": e, "kind": k} for s, e, k in b])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(spans, kind)], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(arrow_rows(find), schema)


def redact(text: str | None, model: SpanModel) -> str | None:
    """Text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if not text:
        return text
    out, at = [], 0
    for s, e, k in all_spans(text, model)[1]:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if at else text


def redact_pii(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", model: SpanModel | None = None) -> DataFrame:
    """df with personal data in text_col replaced and chars_col (if df has it) set anew."""
    model = model or default_model()
    ship(df.sparkSession)
    names, at = df.columns, df.columns.index(text_col)
    kind = df.schema[chars_col].dataType if chars_col in names else None
    schema = df.schema

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(batch.columns)
        cols[at] = pa.array([redact(t.as_py(), model) for t in cols[at]], pa.string())
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    out = df.toDF(*plain.names).mapInArrow(arrow_rows(clean), plain)
    if kind is not None:
        c = f"c{names.index(chars_col)}"
        out = out.withColumn(c, F.length(f"c{at}").cast(kind))
    return out.toDF(*names)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    # sha2 of the base list, as the contract's digest
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
