"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides on spans.

Base spans are found by fixed patterns and always stay. Looser patterns propose further spans of
the same and of other kinds. Every proposal, the base spans among them, is voted on by labelers: its
format, checksums and counts, gazetteers, the words before it, its characters and its borders.

Proposals are counted over all documents by kind, votes and length class; that table is bounded by
its columns. Expectation-maximisation on it estimates how reliable each labeler is for each kind.
A logistic classifier over kind, votes and length class is trained on the posteriors, weighted by
the counts, and decides which proposals become spans. Texts are read in place, twice.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import by_batches, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "name", "secret", "ssn")
LABELERS = ("format", "checksum", "gazetteer", "context", "counter_context", "characters", "borders")
THRESHOLD = 0.5
CONTEXT = 48

# Base patterns. A run of digits is never entered in its middle, so a long one costs no more.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser patterns.
AT_DOT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]? ?at ?[\])]? [A-Za-z0-9-]{1,63} ?[\[(]? ?dot ?[\])]? ?[A-Za-z]{2,10}\b")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-])?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![\w-])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"[:=] ?[\"']?([^\s\"']{8,}+)")
KEY_ID = re.compile(r"(?<![A-Za-z0-9])A[A-Z]{3}[A-Z0-9]{16}(?![A-Za-z0-9])")
TITLE = re.compile(r"(?<!\w)(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Madame|Monsieur|Señora?|Sra?)\.? ([A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?)")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov io info de fr es uk eu ch at it nl example test invalid".split())
IBAN_LANDS = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
GIVEN_NAMES = frozenset(
    "anna anne carlos carmen charles claire david elena emily hans heinrich henri jack james jean john jose juan karl "
    "laura linda luis marc maria marie martin mary michael paul peter pierre robert sarah sofia thomas".split()
)
SECRET_WORDS = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[ _-]?key|access[ _-]?key)[\"']? ?$", re.I)
CONTEXT_WORDS = {
    "email": re.compile(r"mail|contact|write|schreib|écri|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse", re.I),
    "card": re.compile(r"card|karte|carte|tarjeta|visa|payment|credit", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobile|anruf|appel|llama", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "name": re.compile(r"dear|regards|from|by|von|de|sehr geehrte", re.I),
    "secret": SECRET_WORDS,
    "ssn": re.compile(r"ssn|social|security|sozial", re.I),
}
COUNTER_WORDS = re.compile(r"version|license|lizenz|chapter|page|isbn|figure|§|https?:|v\.? ?$", re.I)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Every at-sign with what may stand before and behind it; leftmost, without overlap."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, each in order."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            parts = (p.lstrip("0") for p in m.group().split("."))
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Looser spans; may overlap each other and the base spans."""
    out = []
    if " dot" in text or "dot " in text or "[dot" in text or "(dot" in text:
        out += [("email", *m.span()) for m in AT_DOT.finditer(text)]
    out += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text) if 7 <= len(digits_of(m.group())) <= 15]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits_of(m.group())) <= 19]
    if "-" in text:
        out += [("ssn", *m.span()) for m in SSN.finditer(text)]
    out += [("iban", *m.span()) for m in IBAN.finditer(text)]
    if "=" in text or ":" in text:
        out += [("secret", *m.span(1)) for m in ASSIGNED.finditer(text)]
    out += [("secret", *m.span()) for m in KEY_ID.finditer(text)]
    out += [("name", *m.span(1)) for m in TITLE.finditer(text)]
    return out


def _remainder97(value: str) -> int:
    rest = 0
    for c in value[4:] + value[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """+1, -1 or 0 (no opinion) of every labeler, in the order of LABELERS."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = digits_of(span)
    form = check = listed = chars = 0
    if kind == "email":
        form = 1 if "@" in span else -1
        listed = 1 if re.split(r"[. ]", span.rstrip("])"))[-1].lower() in TOP_DOMAINS else -1
    elif kind == "ip":
        parts = span.split(".")
        form = 1
        check = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        listed = -1 if parts[0] == "0" else 0
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        listed = 1 if digits[0] in "3456" else -1
        form = 1 if len(digits) in (15, 16) else -1
    elif kind == "phone":
        form = 1 if span[0] in "+(0" else -1
        check = 1 if 9 <= len(digits) <= 13 else -1
        chars = -1 if len(set(digits)) < 4 else 1
        listed = -1 if re.fullmatch(r"(?:19|20)[0-9]{2}[ .-](?:19|20)?[0-9]{2}.*", span) else 0
    elif kind == "iban":
        plain = span.replace(" ", "")
        check = 1 if _remainder97(plain) == 1 else -1
        listed = 1 if plain[:2] in IBAN_LANDS else -1
        form = 1 if 15 <= len(plain) <= 34 else -1
        chars = 1 if len(digits) * 2 > len(plain) else -1
    elif kind == "ssn":
        form = 1
        check = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[-4:] == "0000" else 1
    elif kind == "secret":
        form = 1 if KEY_ID.fullmatch(span) or re.fullmatch(r"[0-9a-fA-F]{16,}", span) else -1
        mixed = sum(any(f(c) for c in span) for f in (str.isdigit, str.islower, str.isupper))
        chars = 1 if mixed > 1 and len(set(span)) >= 8 else -1
        listed = 1 if span.startswith("AKIA") or SECRET_WORDS.search(before.rstrip("\"':= ")) else -1
    else:
        words = span.split()
        form = 1 if len(words) == 2 else -1
        listed = 1 if words[0].lower() in GIVEN_NAMES else 0
        chars = 1 if all(w.isalpha() for w in words) else -1
    context = 1 if CONTEXT_WORDS[kind].search(before.rstrip("\"':= ") if kind == "secret" else before) else 0
    counter = -1 if COUNTER_WORDS.search(before[-16:]) else 0
    left = start == 0 or not text[start - 1].isalnum()
    right = end == len(text) or not text[end].isalnum()
    return form, check, listed, context, counter, chars, 1 if left and right else -1


def _key(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a proposal: kind, votes and length class."""
    return (KINDS.index(kind), *votes(text, kind, start, end), min(3, (end - start) // 10))


def _candidates(text: str) -> list[tuple[str, int, int]]:
    return sorted({*base_spans(text), *proposals(text)}, key=lambda s: (s[1], s[1] - s[2], s[0]))


def label_model(keys: np.ndarray, counts: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every row of keys, and reliabilities (kind, class, labeler, vote + 1)."""
    kinds, ballots = keys[:, 0], keys[:, 1 : 1 + len(LABELERS)] + 1
    post = 1 / (1 + np.exp(-1.5 * (ballots - 1).sum(axis=1)))
    shares = np.zeros((len(KINDS), 2, len(LABELERS), 3))
    for _ in range(rounds):
        logs = np.zeros((len(keys), 2))
        for k in range(len(KINDS)):
            rows = kinds == k
            for c, w in enumerate((1 - post, post)):
                mass = counts[rows] * w[rows]
                for j in range(len(LABELERS)):
                    # The prior holds a labeler to be right rather than wrong.
                    prior = np.array([1.0, 1.0, 2.0]) if c else np.array([2.0, 1.0, 1.0])
                    seen = np.bincount(ballots[rows, j], weights=mass, minlength=3) + prior
                    shares[k, c, j] = seen / seen.sum()
                    logs[rows, c] += np.log(shares[k, c, j][ballots[rows, j]])
                logs[rows, c] += np.log(mass.sum() + 1.0)
        post = 1 / (1 + np.exp(-np.clip(logs[:, 1] - logs[:, 0], -40, 40)))
    return post, shares


@dataclass
class Model:
    weights: np.ndarray
    shares: np.ndarray


def _features(keys: np.ndarray) -> np.ndarray:
    """Numbers of the active one-hot features: kind with length class, kind with each vote."""
    n = len(LABELERS)
    columns = [keys[:, 0] * 4 + keys[:, -1]]
    offset = 4 * len(KINDS)
    for j in range(n):
        columns.append(offset + (keys[:, 0] * n + j) * 3 + keys[:, 1 + j] + 1)
    return np.stack(columns, axis=1)


def _width() -> int:
    return 4 * len(KINDS) + 3 * len(KINDS) * len(LABELERS)


def fit(keys: np.ndarray, counts: np.ndarray) -> Model:
    """Label model, then a logistic classifier on its posteriors, weighted by the counts."""
    post, shares = label_model(keys, counts)
    active = _features(keys)
    share = counts / counts.sum() if len(counts) else counts
    w, m, v = np.zeros(_width()), np.zeros(_width()), np.zeros(_width())
    for step in range(1, 601):
        error = (1 / (1 + np.exp(-np.clip(w[active].sum(axis=1), -40, 40))) - post) * share
        grad = np.bincount(active.ravel(), weights=np.repeat(error, active.shape[1]), minlength=_width()) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(w, shares)


def train(docs: DataFrame) -> Model:
    """Count the proposals of all documents and fit the model; no proposals give an even one."""
    names = ["kind", *LABELERS, "size"]

    def run(batches):
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for span in _candidates(text or ""):
                    counts[_key(text, *span)] += 1
        rows = [(*k, n) for k, n in counts.items()]
        columns = list(zip(*rows)) if rows else [[]] * (len(names) + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if i < len(names) else pa.int64()) for i, c in enumerate(columns)], names=[*names, "n"]
        )

    ddl = ", ".join(f"{n} int" for n in names) + ", n long"
    rows = docs.select("text").mapInArrow(run, ddl).groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names).collect()
    if not rows:
        return Model(np.zeros(_width()), np.full((len(KINDS), 2, len(LABELERS), 3), 1 / 3))
    table = np.array([list(r) for r in rows], dtype=np.int64)
    return fit(table[:, :-1], table[:, -1].astype(float))


def spans_of(text: str, model: Model, threshold: float = THRESHOLD) -> list[tuple[str, int, int, bool]]:
    """All spans by kind and start; the flag tells base spans. Added ones overlap no other span."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(k, a, b, True) for k, a, b in base]
    scored = []
    for span in {*proposals(text)} - set(base):
        key = np.array([_key(text, *span)])
        z = model.weights[_features(key)].sum()
        if z > np.log(threshold / (1 - threshold)):
            scored.append((-z, span[1], -span[2], span))
    for *_, (kind, a, b) in sorted(scored):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_personal_data(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with spans: kind, start, end (code points, end exclusive), base.

    Null and empty texts have no spans. Repeated rows get the same spans; a column of docs named
    spans is replaced; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() != "spans"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)

    def run(columns):
        found = [
            [{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in spans_of(t or "", model, threshold)]
            for t in columns["text"].to_pylist()
        ]
        return {c: columns[c] for c in kept} | {"spans": found}

    return by_batches(
        docs.select(*kept), run, fields + "spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    )
