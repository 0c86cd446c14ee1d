"""Personal data: spans by fixed rules, and further ones that labelers vote on, weighed by expectation-maximisation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

KINDS = ("email", "ip", "card", "phone", "name")    # the order of spans that start together; names come from labelers alone
ACCEPT = 0.8          # probability from which the classifier adds a span
ROUNDS = 200          # of expectation-maximisation, at most
BEFORE = 40           # characters ahead of a span that the context labelers read

# What the gazetteers and cues hold.
GIVEN = frozenset("""
James Mary Robert Patricia Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen
Christopher Nancy Daniel Margaret Matthew Sandra Anthony Ashley Mark Emily Donald Kimberly Steven Michelle Hans Peter Wolfgang Klaus Jürgen
Dieter Manfred Uwe Günter Monika Ursula Petra Sabine Renate Helga Jean Pierre Michel Philippe Jacques Marie Nathalie Isabelle Sylvie
Catherine Françoise José Manuel Francisco Carlos Javier Miguel Carmen Josefa Dolores Pilar Teresa Lucía
""".split())
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Monsieur Madame Señor Señora Sra Doña".split())
ENDINGS = frozenset("com org net edu gov info biz io co uk de fr es it nl eu us ca au ch at be".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|3[068]")
CUES = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write|reach|courriel|correo|schreib\w*|kontakt)\b", re.I),
    "ip": re.compile(r"\b(ip|ipv[46]|address|adresse|direcci[oó]n|server|serveur|servidor|host|login)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|karte|kreditkarte|carte|tarjeta|payment|pay)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|telephone|call|mobile|cell|fax|telefon|handy|anruf|t[eé]l[eé]phone|portable|tel[eé]fono|m[oó]vil)\b", re.I),
    "name": re.compile(r"\b(name|named|name is|called|signed|heiße|heißt|nom|appelle|nombre|llamo|llama|dear|regards)\b", re.I)}
AGAINST = re.compile(r"(token|sha\d*|hash|key|version|isbn|issn|doi|order|invoice|serial|build|id|nr|no\.?|=)\W*$", re.I)

EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MORE_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.%+-]{0,63}(?: ?@ ?| ?[\[({] ?(?:at|@) ?[\])}] ?)[A-Za-z0-9-]{1,63}"
                        r"(?:(?: ?\. ?| ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )[A-Za-z0-9-]{1,63}){1,4}")
MORE_IP = re.compile(r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
                     r"|[0-9]{1,4}(?: ?[\[(]\.[\])] ?[0-9]{1,4}){3}|[0-9]{1,6}(?:\.[0-9]{1,6}){3})(?![0-9A-Fa-f:])")
MORE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,18}(?![0-9])")
MORE_PHONE = re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w-])")
MORE_NAME = re.compile(r"[A-ZÀ-Ý][a-zß-ÿ]{1,15}\.?(?: [A-ZÀ-Ý][a-zß-ÿ'-]{1,20}){1,2}")


# ---- spans by rule

def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the rule, found from their @ so that long stretches without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:    # the letters ahead of the @, a stretch at a time
            low = max(done, start - 256)
            found = EMAIL_LOCAL.search(text[low:start])
            if not found:
                break
            start = low + found.start()
            if start > low:
                break
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind in ``KINDS``) of every span that the rules find, in that order."""
    out = [(i, j, 0) for i, j in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 12 or m.end() - m.start() > 37:
            continue
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---- labelers

def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches that resemble personal data and touch no span of the rules, per kind leftmost and non-overlapping."""
    digits = re.search("[0-9]", text) is not None
    found = []
    if "@" in text or " dot " in text or re.search(r"[\[({] ?(at|dot) ?[\])}]", text):
        found += [(*m.span(), 0) for m in MORE_EMAIL.finditer(text)]
    if digits:
        for place, rule in ((1, MORE_IP), (2, MORE_CARD), (3, MORE_PHONE)):
            found += [(*m.span(), place) for m in rule.finditer(text)]
    elif "::" in text:
        found += [(*m.span(), 1) for m in MORE_IP.finditer(text)]
    for m in MORE_NAME.finditer(text):
        start = m.start()
        for word in m.group().split(" ")[:-1]:
            if word.rstrip(".") in GIVEN or word.rstrip(".") in TITLES:
                found.append((start, m.end(), 4))
                break
            start += len(word) + 1
    found.sort(key=lambda s: (s[0], s[2]))
    out, held = [], []
    spans = iter(sorted(base))
    ahead = next(spans, None)
    for s in found:    # both in order of their start; only spans that may reach this far are kept
        while ahead and ahead[0] < s[1]:
            held.append(ahead)
            ahead = next(spans, None)
        held = [h for h in held if h[1] > s[0]]
        if not any(h[0] < s[1] for h in held):
            out.append(s)
    return out


def _format(kind: int, said: str, digits: str) -> int:
    if kind == 0:
        return 1 if re.fullmatch(r"[A-Za-z0-9][\w.%+-]*@[\w-]+(\.[\w-]+)+", said) else -1 if " @ " in said else 0
    if kind == 1:
        return 1 if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}|([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", said) else 0
    if kind == 2:
        return 1 if re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}", said) else 0
    if kind == 3:
        shapes = r"\+[0-9]{1,3}[ (.-].*|\(0?[0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,5}|0[0-9]{1,4}[ /-][0-9 .-]{5,}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
        return -1 if re.fullmatch(r"[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}", said) else 1 if re.fullmatch(shapes, said) else 0
    return 1 if 2 <= len(said.split()) <= 3 else 0


def _checked(kind: int, said: str, digits: str) -> int:
    if kind == 0:
        return 1 if re.search(r"[A-Za-z]{2,}\W*\Z", said) else -1
    if kind == 1:
        if ":" in said:
            return 1 if said.count(":") == 7 or said.count("::") == 1 else -1
        return 1 if all(int(p) <= 255 for p in re.findall("[0-9]+", said)) else -1
    if kind == 2:
        return 1 if luhn(digits) else -1
    if kind == 3:
        return 1 if 9 <= len(digits) <= 15 else -1
    return 0


def _listed(kind: int, said: str, digits: str) -> int:
    if kind == 0:
        return 1 if re.findall("[A-Za-z]+", said)[-1:] and re.findall("[A-Za-z]+", said)[-1].lower() in ENDINGS else -1
    if kind == 1:
        return -1 if re.match(r"0+\.|([0-9])\.\1\.|[0-9]\.[0-9]\.[0-9]\.[0-9]\Z", said) else 0
    if kind == 2:
        return 1 if ISSUERS.match(digits) else -1
    if kind == 3:
        return 1 if said[0] in "+(" or digits[0] == "0" else -1
    return 1 if said.split()[0].rstrip(".") in GIVEN or any(w in GIVEN for w in said.split()[1:]) else 0


def _repeated(digits: str) -> int:
    """Against numbers that are one digit or one run of neighbours."""
    return -1 if len(digits) > 5 and (len(set(digits)) < 3 or digits in "01234567890123456789" or digits in "98765432109876543210") else 0


def votes(text: str, start: int, end: int, kind: int) -> tuple[int, ...]:
    """1, 0 or -1 of every labeler: three on the form, one on lists, two on what stands ahead, one on the neighbours, one on digits."""
    said = text[start:end]
    digits = re.sub("[^0-9]", "", said)
    ahead = text[max(0, start - BEFORE):start]
    left, right = text[start - 1:start], text[end:end + 1]
    alone = (not left or left.isspace() or left in "\"'([{<|,;:*") and (not right or not right.isalnum())
    return (_format(kind, said, digits), _checked(kind, said, digits), _listed(kind, said, digits), 1 if CUES[KINDS[kind]].search(ahead) else 0,
            -1 if AGAINST.search(ahead) else 0, 1 if alone else -1, _repeated(digits))


VOTES = 7
SHAPES = (4, 4, 3)    # classes of length, of separators and of the share of digits


def shape(said: str) -> tuple[int, int, int]:
    marks = sum(not c.isalnum() for c in said)
    share = sum(c.isdigit() for c in said) / len(said)
    return min(3, len(said) // 8), min(3, marks // 2), 0 if share < 0.2 else 1 if share < 0.8 else 2


def pattern(text: str, start: int, end: int, kind: int) -> int:
    """Kind, votes and shape as one number; there are fewer than 5 * 3 ** 7 * 48 of them."""
    code = kind
    for vote in votes(text, start, end, kind):
        code = code * 3 + vote + 1
    for n, many in zip(shape(text[start:end]), SHAPES):
        code = code * many + n
    return code


def parsed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and shapes of patterns."""
    codes = codes.copy()
    shapes, said = [], []
    for many in reversed(SHAPES):
        codes, n = np.divmod(codes, many)
        shapes.append(n)
    for _ in range(VOTES):
        codes, n = np.divmod(codes, 3)
        said.append(n - 1)
    return codes, np.stack(said[::-1], axis=1), np.stack(shapes[::-1], axis=1)


# ---- model

SMOOTH = 4.0                                   # rows that a labeler starts with
START = np.array([[0.3, 0.5, 0.2], [0.1, 0.5, 0.4]])    # and their votes of -1, 0, 1 on stretches that are not, or are, personal data


def reliabilities(kinds: np.ndarray, said: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every pattern, and per labeler the shares of its votes given the truth, by expectation-maximisation.

    Labelers are taken to err independently given the truth; each kind has its own share of true spans.  The start is
    the majority of the votes, so the result is the same at every run.
    """
    q = 1 / (1 + np.exp(-2.0 * said.sum(axis=1)))
    shares = np.empty((2, said.shape[1], 3))
    for _ in range(ROUNDS):
        prior = np.ones(len(q))
        for kind in np.unique(kinds):
            own = kinds == kind
            prior[own] = ((counts * q)[own].sum() + 1) / (counts[own].sum() + 2)
        for truth, weight in ((0, counts * (1 - q)), (1, counts * q)):
            for vote in (-1, 0, 1):
                shares[truth, :, vote + 1] = weight @ (said == vote) + SMOOTH * START[truth, vote + 1]
        shares /= shares.sum(axis=2, keepdims=True)
        odds = np.log(prior / (1 - prior))
        for labeler in range(said.shape[1]):
            column = said[:, labeler] + 1
            odds += np.log(shares[1, labeler, column] / shares[0, labeler, column])
        last, q = q, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(q - last).max() < 1e-9:
            break
    return q, shares


def features(kinds: np.ndarray, said: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    columns = [kinds == k for k in range(len(KINDS))] + [said[:, i] == v for i in range(said.shape[1]) for v in (-1, 1)]
    columns += [shapes[:, i] == n for i, many in enumerate(SHAPES) for n in range(1, many)]
    return np.stack(columns, axis=1).astype(np.float64)


def fitted(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic regression on probabilities ``y`` by damped Newton steps."""
    w = np.zeros(x.shape[1])

    def loss(w):
        return counts @ (np.logaddexp(0, x @ w) - y * (x @ w)) + ridge * (w @ w) / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (y - p)) - ridge * w)
        length = 1.0
        while length > 1e-6 and loss(w + length * step) > loss(w):
            length /= 2
        w = w + length * step
        if np.abs(length * step).max() < 1e-10:
            break
    return w


@dataclass(frozen=True)
class Classifier:
    """The votes' reliabilities and the weights of the span classifier."""

    shares: np.ndarray
    weights: np.ndarray

    def score(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(*parsed(codes)) @ self.weights, -500, 500)))


def train(codes: np.ndarray, counts: np.ndarray) -> Classifier:
    kinds, said, shapes = parsed(codes)
    q, shares = reliabilities(kinds, said, counts.astype(np.float64))
    return Classifier(shares, fitted(features(kinds, said, shapes), q, counts.astype(np.float64)))


# ---- tables

def spelt(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, j, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, more string, patterns array<long>"


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id of every row, the spans of the rules, the stretches to judge, and the patterns of both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = further_spans(text, base)
                counts = [sum(s[2] == k for s in base) for k in range(4)]
                said = spelt(base)
                codes = [pattern(text, *s) for s in (*base, *more)]
                rows.append((*counts, hashlib.sha256(said.encode()).hexdigest(), said, ",".join(f"{i}:{j}:{k}" for i, j, k in more), codes))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [*[pa.int64()] * 4, *[pa.string()] * 3, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", *[c.split()[0] for c in FOUND.split(", ")]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    The four counts and base_sha256 (of "kind:start:end" joined by commas; code points, end exclusive) are of the spans
    that fixed rules find.  ``spans`` holds these and the ones that the classifier adds, joined alike: emails written
    with (at) and (dot), addresses of other forms, phone numbers without +, card numbers with other separators, names.

    Method: further stretches that resemble personal data are judged together with the rules' spans by labelers:
    patterns of the usual form, checksums and ranges, gazetteers (name endings of hosts, card issuers, given names),
    cues ahead for and against, and the neighbours.  Each votes for, against or not at all.  Expectation-maximisation
    over all stretches of the corpus estimates how reliable each vote is, without any labels, and its posteriors train
    a logistic classifier on kind, votes and shape.  A stretch that it gives ``accept`` or more is added.  Stretches
    that touch a span of the rules are not judged; the rules' spans always stay.

    Texts are read once, whole, where they lie, in time linear in their length; the spans of a text are one row.
    Votes and shapes are one number of bounded range, so what Spark counts and hands to the driver is at most one row
    per pattern (under 525,000), however many stretches there are.  Null texts are empty.  Rows that repeat a doc_id, or
    have none, are rows of their own.  No stretches: nothing is added.  No documents: no rows.  Further columns are not read.
    """
    found = written(found_spans(docs), "personal-data")
    counted = found.select(F.explode("patterns").alias("code")).groupBy("code").count().toPandas().sort_values("code")
    codes = counted["code"].to_numpy(np.int64)
    good = set()
    if len(codes):
        score = train(codes, counted["count"].to_numpy(np.int64)).score(codes)
        good = set(codes[score >= accept].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, more, codes in zip(*(batch.column(c).to_pylist() for c in ("base", "more", "patterns"))):
                if more:
                    judged = [tuple(map(int, s.split(":"))) for s in more.split(",")]
                    added = [s for s, code in zip(judged, codes[len(codes) - len(judged):]) if code in good]
                    if added:
                        ruled = [s.split(":") for s in base.split(",")] if base else []
                        base = spelt([*[(int(i), int(j), KINDS.index(k)) for k, i, j in ruled], *added])
                spans.append(base)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.array(spans, pa.string())], [*batch.schema.names[:6], "spans"])

    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return found.select(*columns, "base", "more", "patterns").mapInArrow(run, schema)


def op13_personal_data(docs: DataFrame) -> DataFrame:
    return personal_data(docs)
