"""Personal data: exact base patterns, and a semi-Markov conditional random field over whole candidate spans.

The base patterns decide what is surely personal data. Where two items stand side by side a greedy pattern runs
them together and its check fails; obfuscated addresses and local phone numbers fit no pattern at all. For these a
semi-Markov CRF scores whole candidate segments by features of the span (digits, groups, separators, checksum,
ranges, words before) and of the pair of neighbouring types (a card must pass its check), and dynamic programming over segments of bounded
length chooses boundaries and types jointly. It adds spans only outside base spans. The model is trained here, by
the gradient of the log-likelihood, on generated sentences; its weights (some hundred numbers) go to the tasks.

Everything is linear in a text's length: candidates arise only around digits and at-signs, and a candidate has at
most MOST_CHUNKS chunks. No shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import slices

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive digits give the same matches without retries from inside a number.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HINT = re.compile(r"[0-9@]|[(\[]at[)\]]| dot ")
CHAIN = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,3}[0-9])*")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(at\)|\[at\]|@) ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]{1,63}){1,4}")
MOST_CHUNKS = 6

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """As the pattern finds them, but from each at-sign outwards, which takes linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed in KINDS, then by start."""
    if not HINT.search(text):
        return []
    out = list(emails(text))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Segments that may be personal data, outside the spans taken."""
    free = np.ones(len(text) + 1, bool)
    for _, a, b in taken:
        free[a:b] = False
    out = set()
    for m in CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        chunks = [(m.start() + c.start(), m.start() + c.end()) for c in re.finditer(r"\S+", m[0])]
        for i, (a, _) in enumerate(chunks):
            for _, b in chunks[i : i + MOST_CHUNKS]:
                n = len(digits_of(text[a:b])) if b - a <= 40 else 99
                if n > 19:
                    break
                if n >= 7 or text.count(".", a, b) == 3:
                    out.add((a, b))
    if "@" in text or "at)" in text or "at]" in text or " dot " in text:
        for hint in re.finditer(r"@|[(\[]at[)\]]| at (?=[A-Za-z0-9-]{1,63} dot )", text):
            begin = hint.start()
            while begin > 0 and hint.start() - begin < 65 and (text[begin - 1] in LOCAL or begin == hint.start() and text[begin - 1] == " "):
                begin -= 1
            if m := ADDRESS.match(text, begin):
                out.add((m.start(), m.end()))
    return sorted((a, b) for a, b in out if free[a:b].all())


def features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Names of the features of segment [a, b) as a span of a kind."""
    span, before = text[a:b], text[max(0, a - 12) : a].lower()
    digits = digits_of(span)
    n = len(digits)
    parts = span.split(".")
    ip = len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    joined = a > 0 and not text[a - 1].isspace() and text[a - 1] not in "(\"',;:" or b < len(text) and text[b].isalnum()
    date = re.fullmatch(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}", span) is not None
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    shape = "-".join(map(str, groups)) if len(groups) <= 5 else "many"
    names = [
        "bias", f"digits={n if n < 20 else 20}", f"ip={ip}", f"luhn={n >= 13 and luhn(digits)}", f"plus={span[0] == '+'}", f"bracket={'(' in span and ')' in span}", f"even={span.count('(') == span.count(')')}", f"groups={min(len(groups), 6)}",
        f"at={'@' in span or '(at)' in span or '[at]' in span}", f"dot={' dot ' in span or '(dot)' in span or '[dot]' in span}", f"letters={any(c.isalpha() for c in span)}", f"joined={joined}", f"date={date}", f"shape={shape}",
        f"word={bool(re.search(r'(?:tel|fon|phone|call|mobile|fax)[^a-z]*$', before))}", f"slash={'/' in span}", f"one_group={len(groups) == 1}", f"bare={len(groups) == 1 and span[0] not in '+('}",
    ]
    return [f"{kind}:{name}" for name in names]


#: The weights of the segment features, then of pairs of neighbouring types.
Model = dict[str, float]


def _score(model: Model, names: list[str]) -> float:
    return sum(model.get(name, 0.0) for name in names)


def may_be(text: str, a: int, b: int, kind: str) -> bool:
    """Whether the segment can be of the kind at all: a card has 13 to 19 digits that pass the Luhn check."""
    return kind != "card" or 13 <= len(digits := digits_of(text[a:b])) <= 19 and luhn(digits)


def lattice(text: str, segments: list[tuple[int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """Every segment as every type that it can have, by end."""
    return sorted(((a, b, kind, features(text, a, b, kind)) for a, b in segments for kind in KINDS if may_be(text, a, b, kind)), key=lambda x: (x[1], x[0]))


def pair(before: str | None, kind: str) -> str:
    return f"{before or 'start'}>{kind}"


def decode(model: Model, text: str, segments: list[tuple[int, int]]) -> list[Span]:
    """The best set of segments that don't overlap, by dynamic programming over segment ends."""
    nodes = lattice(text, segments)
    # best[kind] = the best score of a prefix whose last entity has that kind, as it stands at the ends passed so far
    ends: list[tuple[int, dict]] = [(0, {None: (0.0, None)})]
    i = 0
    while i < len(nodes):
        end = nodes[i][1]
        now = dict(ends[-1][1])
        while i < len(nodes) and nodes[i][1] == end:
            a, b, kind, names = nodes[i]
            own = _score(model, names)
            at = len(ends) - 1
            while ends[at][0] > a:
                at -= 1
            for last, (score, path) in ends[at][1].items():
                total = score + own + model.get(pair(last, kind), 0.0)
                if total > now.get(kind, (-math.inf,))[0]:
                    now[kind] = (total, ((kind, a, b), path))
            i += 1
        ends.append((end, now))
    _, path = max(ends[-1][1].values(), key=lambda x: x[0])
    out = []
    while path:
        span, path = path
        out.append(span)
    return out[::-1]


def gradient(model: Model, text: str, segments: list[tuple[int, int]], truth: set[Span], out: dict[str, float]) -> None:
    """Add the gradient of log p(truth | text): its features less their expectation, by forward and backward sums."""
    nodes = lattice(text, segments)
    n = len(nodes)
    own = [_score(model, names) for *_, names in nodes]
    before = [[j for j in range(i) if nodes[j][1] <= nodes[i][0]] for i in range(n)]
    forward, backward = [0.0] * n, [0.0] * n

    def total(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    for i in range(n):
        forward[i] = own[i] + total([model.get(pair(None, nodes[i][2]), 0.0)] + [forward[j] + model.get(pair(nodes[j][2], nodes[i][2]), 0.0) for j in before[i]])
    after: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        for j in before[i]:
            after[j].append(i)
    for i in reversed(range(n)):
        backward[i] = total([0.0] + [backward[j] + own[j] + model.get(pair(nodes[i][2], nodes[j][2]), 0.0) for j in after[i]])
    whole = total([0.0, *forward])
    for i in range(n):
        for name in nodes[i][3]:
            out[name] = out.get(name, 0.0) - math.exp(forward[i] + backward[i] - whole)
        for j in [None, *before[i]]:
            p = (0.0 if j is None else forward[j]) + model.get(key := pair(None if j is None else nodes[j][2], nodes[i][2]), 0.0) + own[i] + backward[i]
            out[key] = out.get(key, 0.0) - math.exp(p - whole)
    last = None
    for a, b, kind, names in nodes:
        if (kind, a, b) in truth:
            for name in [*names, pair(last, kind)]:
                out[name] = out.get(name, 0.0) + 1
            last = kind


def example(rng: random.Random) -> tuple[str, set[Span]]:
    """A generated sentence and its spans."""

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        digits = rng.choice("3456") + number(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return rng.choice([digits, digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b} {c}", f"+{number(2)}{a}{b}{c}"])

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "."), ("@", ".")])
        return f"{word()}.{word()}{at}{word()}{dot}com"

    def not_a_card() -> str:
        digits = number(rng.randint(13, 19))
        digits = digits[:-1] + next(c for c in rng.sample("0123456789", 10) if not luhn(digits[:-1] + c))
        by_four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice([digits, " ".join(by_four), "-".join(by_four)])

    def none() -> str:
        return rng.choice([
            not_a_card(), not_a_card(), " ".join([number(rng.randint(1, 3)), *(number(3) for _ in range(rng.randint(2, 4)))]), f"{number(rng.randint(1, 3))}.{number(rng.randint(2, 5))} {number(rng.randint(1, 3))}.{number(rng.randint(2, 5))}",
            number(rng.randint(7, 19)), ".".join(sorted((number(rng.randint(1, 3)), number(rng.randint(1, 2)), str(rng.randint(256, 5000)), number(1)), key=lambda _: rng.random())), f"20{number(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.19{number(2)}",
            f"version {number(1)}.{number(1)}", f"{number(3)} {number(3)} {number(3)}", f"{number(4)} {number(4)}", f"{word()}@{word()}", f"look at {word()}", f"token={number(9)}{word()}{number(7)}", f"20{number(2)} 20{number(2)}", f"{number(2)}/{number(2)}/20{number(2)}",
        ])

    makers = {"card": card, "phone": phone, "ip": ip, "email": email, None: none}
    text, truth = "", set()
    for _ in range(rng.randint(1, 3)):
        for _ in range(rng.randint(0, 3)):
            text += word() + " "
        kind = rng.choice(list(makers))
        made = makers[kind]()
        if kind:
            truth.add((kind, len(text), len(text) + len(made)))
        text += made + rng.choice([" ", " ", " ", ". ", ", "])
    return text + word(), truth


@functools.lru_cache(1)
def train(examples: int = 300, steps: int = 50, seed: int = 7) -> Model:
    """Gradient ascent with a Gaussian prior; always the same weights."""
    rng = random.Random(seed)
    data = []
    while len(data) < examples:
        text, truth = example(rng)
        segments = candidates(text, [])
        if segments and {(a, b) for _, a, b in truth} <= set(segments):
            data.append((text, segments, truth))
    model: Model = {}
    squares: dict[str, float] = {}
    for _ in range(steps):
        out: dict[str, float] = {}
        for row in data:
            gradient(model, *row, out)
        for name, g in out.items():
            g -= 0.5 * model.get(name, 0.0)
            squares[name] = squares.get(name, 0.0) + g * g
            model[name] = model.get(name, 0.0) + 0.5 * g / math.sqrt(squares[name] + 1e-9)
    return {k: round(v, 6) for k, v in model.items()}


def added_spans(model: Model, text: str, base: list[Span]) -> list[Span]:
    """What the model adds to the base spans. Candidates far apart are decoded apart."""
    if not HINT.search(text):
        return []
    out: list[Span] = []
    group: list[tuple[int, int]] = []
    for a, b in [*candidates(text, base), (1 << 62, 1 << 62)]:
        if group and a > max(e for _, e in group[-2 * MOST_CHUNKS :]) + 40:
            left, right = max(0, group[0][0] - 16), max(e for _, e in group) + 16
            found = decode(model, text[left:right], [(x - left, y - left) for x, y in group])
            out += [(kind, x + left, y + left) for kind, x, y in found]
            group = []
        group.append((a, b))
    return out


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, redacted for every row.

    Spans are kind:start:end in code points, end exclusive, by kind (email, ip, card, phone), then start; base_sha256
    hashes the base spans so joined, `spans` has all. Base spans of different kinds may overlap, added ones overlap
    nothing. In `redacted` each span, overlapping ones together, is replaced by its kind in brackets; null text stays
    null there and has no spans. Repeated rows give repeated results; no rows give none; other columns are ignored.
    """
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, there in zip(batch.column("text").to_pylist(), batch.column("there").to_pylist(), strict=True):
                base = base_spans(text)
                extra = added_spans(model, text, base)
                every = sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1])) if extra else base
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(extra), redact(text, every) if there else None))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "redacted"])

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string"
    return documents.selectExpr(f"`{id_column}` AS doc_id", f"coalesce(`{text_column}`, '') AS text", f"`{text_column}` IS NOT NULL AS there").mapInArrow(run, schema)


def redact_documents(documents: DataFrame, text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """The documents with spans replaced by their kinds; `size_column`, where there is one, is set to the new size.

    All other columns, whatever their names and types, come back as they were. Null text stays null.
    """
    model = train()
    schema = documents.schema
    text, size = schema.fieldNames().index(text_column), schema.fieldNames().index(size_column) if size_column in schema.fieldNames() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = []
            for value in batch.column(text).to_pylist():
                base = base_spans(value or "")
                shown.append(value if value is None else redact(value, base + added_spans(model, value, base)))
            columns = list(batch.columns)
            columns[text] = pa.array(shown, pa.string())
            if size is not None:
                columns[size] = pa.array([old if new is None else len(new) for new, old in zip(shown, columns[size].to_pylist(), strict=True)], pa.int64()).cast(columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return documents.mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced; of overlapping spans the first names the kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
