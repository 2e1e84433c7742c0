"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans.  The random field is trained on a small labelled table written
below; it reads windows of words around digits, at-signs and their spelled-out forms, is decoded by
Viterbi for many windows at a time, and adds spans that the patterns miss.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsift.llm.common import text_of_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
MARGIN = 6  # words without a sign of personal data that a window takes along on either side
WINDOWS = 512  # windows decoded at a time
PIECE = 256  # words of a longer window whose features are in memory at a time
EPOCHS = 100
EXAMPLES = 405  # rows of the labelled table
SEED = 7

# The base patterns.  Searched as they stand, EMAIL and IP try every place of a long run anew;
# ``emails`` and ``addresses`` find the same matches in one pass.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAILBOX = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBER = re.compile(r"[0-9]++")

SIGN = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]", re.IGNORECASE)
WORD = re.compile(r"\S+")
_TAIL = "!#$%&*|,;:.\"'?"
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = "".join(DIGITS.findall(text))
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL: every at-sign ends one run of mailbox letters, whatever place of the run is tried first."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = free + len(text[free:at].rstrip(MAILBOX))
        if domain and start < at:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of IP: four whole numbers with one dot between each two."""
    chain: list[int] = []
    end = -1
    for m in NUMBER.finditer(text):
        if m.start() != end + 1 or text[end] != ".":
            chain = []
        chain.append(m.start())
        end = m.end()
        if len(chain) == 4:
            yield chain[0], end
            chain, end = [], -1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    if "@" in text:
        found += [(a, b, 0) for a, b in emails(text)]
    if DIGITS.search(text):
        found += [(a, b, 1) for a, b in addresses(text) if is_ip(text[a:b])]
        found += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if is_card(m.group())]
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m.group())) <= 15]
    return sorted(found)


def features(word: str) -> list[str]:
    """Word-shape features of one word."""
    core = word.rstrip(_TAIL).lstrip("\"'")
    digits = DIGITS.findall(core)
    if not core:
        return ["mark"]
    if not digits and "@" not in core and core.isalpha():
        lower = core.lower()
        return ["plain", f"plain={lower}" if lower in ("at", "dot") else "letters"]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", core)))
    run = re.sub(r"9+", "9", shape)
    n = len(digits)
    out = [f"shape={shape}" if len(shape) < 24 else "shape=long", f"run={run}" if len(run) < 16 else "run=long", f"digits={min(n, 20)}"]
    out += [f"first={core[:1] if not core[:1].isalnum() else 'x'}", f"last={core[-1:] if not core[-1:].isalnum() else 'x'}"]
    if "@" in core:
        out.append("at-sign" if EMAIL.fullmatch(core) else "at-sign alone")
    if SIGN.fullmatch(core):
        out.append("spelled")
    if run == "9.9.9.9":
        out.append("octets" if is_ip(core) else "no octets")
    if n >= 14:
        out.append("check digit" if is_card(core) else "no check digit")
    return out


def sequence_features(words: list[str]) -> list[list[str]]:
    """Features of the words of a window; a word also knows whether a spelled-out sign stands beside it."""
    spelled = [bool(SIGN.fullmatch(w.rstrip(_TAIL))) and not DIGITS.search(w) for w in words]
    return [
        features(w) + ["after spelled"] * (k > 0 and spelled[k - 1]) + ["before spelled"] * (k + 1 < len(words) and spelled[k + 1])
        for k, w in enumerate(words)]


# The labelled table: sentences in which {kind} stands for a value; ``_value`` makes values of each form.
SENTENCES = (
    "write to {email} before noon", "my address is {email}, thanks", "mail {email} or ring {phone}", "{email}", "reply {email} now please",
    "ring me on {phone} tomorrow", "the number {phone} is mine", "phone: {phone}", "{phone} is where to find us", "fax {phone}.",
    "from {ip} at night", "the host {ip} answered", "blocked {ip}, again", "{ip}", "logged in by {ip} and left",
    "paid with {card} yesterday", "card number {card} expired", "{card}", "charge {card} please", "use {card} for the order",
    "see version {number} of the text", "on page {number} and later", "licensed under CC BY-NC {number}", "token = {secret} was set",
    "it cost {number} in {number}", "between {number} and {number} people", "room {number}, floor {number}", "the key {secret} leaked",
    "a line of plain words without anything", "meet at the dot of noon", "section {number} says so", "born in {number} there", "{secret}",
    "one | two | {number} | three", "stay | {secret} | there |", "the * or - sign {number}", "as {number} counted", "token = {secret} | more",
    "{card} {phone}", "{email} {card} {ip}", "{phone} | {email} | rest | of it", "order {number} {number} was late", "| {ip} |",
)


def _value(kind: str, rng: random.Random) -> list[str]:
    """The words of a made value of the kind."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    no_card = lambda: next(x for x in iter(lambda: digits(16), None) if not luhn(x))
    if kind == "email":
        name, host, top = letters(2, 8) + rng.choice(["", f".{digits(2)}", f".{letters(3, 6)}"]), letters(3, 8) + rng.choice(["", digits(1)]), rng.choice(["com", "org", "net", "example.com"])
        form = rng.randrange(4)
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}")])
        return ([f"{name}@{host}.{top}"], [f"{name}@{host}.{top}"], [name, at, f"{host}.{top}"], [name, at, host, dot, top.split(".")[-1]])[form]
    if kind == "ip":
        return [".".join(str(rng.randint(0, 255)) for _ in range(4))]
    if kind == "card":
        head = digits(15)
        number = next(head + d for d in "0123456789" if luhn(head + d))
        parts = [number[k:k + 4] for k in range(0, 16, 4)]
        return ([number], [number], parts, ["-".join(parts)], [".".join(parts)])[rng.randrange(5)]
    if kind == "phone":
        area, one, two = digits(3), digits(3), digits(4)
        return rng.choice([[f"+{digits(1)}", f"({area})", f"{one}-{two}"], [f"({area})", f"{one}-{two}"], [f"{area}-{one}-{two}"],
                           [f"+{digits(2)}", digits(2), two, digits(4)], [f"+{digits(2)}-{digits(2)}-{digits(6)}"], [f"({area})", one, two]])
    if kind == "secret":
        return ['"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
    return [rng.choice([digits(rng.randint(1, 9)), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", no_card(), no_card(), no_card(), f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
                        f"{digits(2)}:{digits(2)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{rng.randint(256, 999)}.{digits(3)}.3.4", f"{digits(2)}-{digits(2)}", f"+{digits(1)}", f"${digits(2)}.{digits(2)}", f"({digits(4)})", f"({digits(1)})"])]


def labelled_table(rows: int = EXAMPLES, seed: int = SEED) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of the small labelled table."""
    rng, out = random.Random(seed), []
    for k in range(rows):
        words, tags = [], []
        for word in SENTENCES[k % len(SENTENCES)].split():
            slot = re.search(r"\{(\w+)\}", word)
            value = _value(slot[1], rng) if slot else [word]
            value[-1] += word[slot.end():] if slot else ""
            if slot and rng.random() < 0.2:
                value[-1] += rng.choice(["###", "***", "$$$", "!!", "."])
            words += value
            kind = slot[1] if slot and slot[1] in KINDS else None
            tags += [f"B-{kind}", *[f"I-{kind}"] * (len(value) - 1)] if kind else ["O"] * len(value)
        out.append((words, tags))
    return out


def padded(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (sequence, place, feature) with -1 for none, and the lengths."""
    length = max(map(len, sequences), default=0)
    width = max((len(f) for s in sequences for f in s), default=0)
    table = np.full((len(sequences), length, max(1, width)), -1)
    for i, sequence in enumerate(sequences):
        for j, numbers in enumerate(sequence):
            table[i, j, :len(numbers)] = numbers
    return table, np.array([len(s) for s in sequences])


class RandomField:
    """Linear-chain conditional random field with first-order transitions."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers
        self.weights = np.zeros((len(numbers) + 1, len(LABELS)))  # the last row stays 0, for no feature
        self.steps = np.zeros((len(LABELS), len(LABELS)))
        for a, one in enumerate(LABELS):
            for b, two in enumerate(LABELS):
                if two[0] == "I" and one[1:] != two[1:]:
                    self.steps[a, b] = -1e4  # a part follows only its own beginning
        self.start = np.array([-1e4 if one[0] == "I" else 0.0 for one in LABELS])

    def encode(self, words: list[str]) -> list[list[int]]:
        return [[self.numbers[f] for f in found if f in self.numbers] for found in sequence_features(words)]

    def emissions(self, table: np.ndarray) -> np.ndarray:
        return self.weights[table].sum(axis=2)

    def train(self, rows: list[tuple[list[str], list[str]]], epochs: int = EPOCHS, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """Maximum likelihood by Adam steps over all rows at once."""
        table, sizes = padded([self.encode(words) for words, _ in rows])
        n, length, _ = table.shape
        gold = np.zeros((n, length), int)
        for i, (_, tags) in enumerate(rows):
            gold[i, :len(tags)] = [LABELS.index(t) for t in tags]
        inside = np.arange(length) < sizes[:, None]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.weights, self.steps)]
        soft = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
        for epoch in range(1, epochs + 1):
            emit = self.emissions(table)
            ahead, back = np.zeros_like(emit), np.zeros_like(emit)
            ahead[:, 0] = self.start + emit[:, 0]
            for t in range(1, length):
                grown = emit[:, t] + soft(ahead[:, t - 1, :, None] + self.steps, 1)
                ahead[:, t] = np.where(inside[:, t, None], grown, ahead[:, t - 1])
            for t in range(length - 2, -1, -1):
                grown = soft(self.steps + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(inside[:, t + 1, None], grown, back[:, t])
            whole = soft(ahead[:, -1], 1)
            chance = np.exp(ahead + back - whole[:, None, None]) * inside[:, :, None]
            want = np.eye(len(LABELS))[gold] * inside[:, :, None]
            by_label = np.zeros_like(self.weights)
            np.add.at(by_label, table, (want - chance)[:, :, None, :])
            by_label[-1] = 0
            pair = np.exp(ahead[:, :-1, :, None] + self.steps + (emit + back)[:, 1:, None, :] - whole[:, None, None, None])
            pair = (pair * inside[:, 1:, None, None]).sum(axis=(0, 1))
            pair_want = np.zeros_like(self.steps)
            np.add.at(pair_want, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
            for k, (values, slope) in enumerate(((self.weights, by_label), (self.steps, pair_want - pair))):
                slope = slope / n - ridge * np.where(values > -1e3, values, 0)
                first, second = state[k]
                first += 0.1 * (slope - first)
                second += 0.001 * (slope**2 - second)
                values += rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)

    def decode(self, windows: list[list[str]]) -> list[list[str]]:
        """Best labels of each window, by Viterbi over all windows at once."""
        table, sizes = padded([self.encode(words) for words in windows])
        emit = self.emissions(table)
        n, length = emit.shape[:2]
        best = self.start + emit[:, 0]
        before = np.zeros((n, length, len(LABELS)), int)
        for t in range(1, length):
            paths = best[:, :, None] + self.steps
            before[:, t] = paths.argmax(axis=1)
            grown = paths.max(axis=1) + emit[:, t]
            best = np.where((t < sizes)[:, None], grown, best)
        at = best.argmax(axis=1)
        chosen = np.zeros((n, length), int)
        for t in range(length - 1, -1, -1):
            chosen[:, t] = at
            at = np.where(t < sizes, before[np.arange(n), t, at], at) if t else at
        return [[LABELS[c] for c in chosen[i, :size]] for i, size in enumerate(sizes)]

    def decode_run(self, words: list[str], piece: int) -> list[str]:
        """Best labels of one window of any length: as ``decode``, features of ``piece`` words in memory at a time."""
        before = np.zeros((len(words), len(LABELS)), np.uint8)
        best = None
        for at in range(0, len(words), piece):
            left = max(0, at - 1)  # a word's features look at one word on either side
            table, _ = padded([self.encode(words[left:at + piece + 1])[at - left:at - left + piece]])
            for t, emit in enumerate(self.emissions(table)[0], at):
                if best is None:
                    best = self.start + emit
                    continue
                paths = best[:, None] + self.steps
                before[t] = paths.argmax(axis=0)
                best = paths.max(axis=0) + emit
        at = int(best.argmax())
        chosen = [at]
        for t in range(len(words) - 1, 0, -1):
            at = int(before[t, at])
            chosen.append(at)
        return [LABELS[c] for c in reversed(chosen)]


def train(rows: list[tuple[list[str], list[str]]] | None = None) -> RandomField:
    rows = labelled_table() if rows is None else rows
    names = sorted({f for words, _ in rows for found in sequence_features(words) for f in found})
    field = RandomField({f: k for k, f in enumerate(names)})
    field.train(rows)
    return field


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words, as (start, end), around signs of personal data; MARGIN words on either side."""
    if not SIGN.search(text):
        return []
    found: list[list[tuple[int, int]]] = []
    recent: list[tuple[int, int]] = []
    left = 0
    for m in WORD.finditer(text):
        span = m.span()
        if SIGN.search(m.group()):
            if left:
                found[-1].append(span)
            else:
                found.append([*recent, span])
            left, recent = MARGIN, []
        elif left:
            found[-1].append(span)
            left -= 1
            recent = []
        else:
            recent = [*recent[1 - MARGIN:], span]
    return found


def added_spans(text: str, places: list[tuple[int, int]], labels: list[str], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of a decoded window that touch no base span, without the marks around them."""
    out, k = [], 0
    while k < len(labels):
        if labels[k][0] != "B":
            k += 1
            continue
        kind, first = KINDS.index(labels[k][2:]), k
        k += 1
        while k < len(labels) and labels[k] == f"I-{KINDS[kind]}":
            k += 1
        start, end = places[first][0], places[k - 1][1]
        while end > start and text[end - 1] in _TAIL:
            end -= 1
        while start < end and text[start] in _TAIL:
            start += 1
        if end > start and not any(start < b[1] and b[0] < end for b in base):
            out.append((start, end, kind))
    return out


def find_spans(texts: list[str], field: RandomField) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text, each (start, end, number of the kind), sorted."""
    out: list[tuple[list, list]] = []
    waiting: list[tuple[int, list[tuple[int, int]]]] = []

    def decode() -> None:
        if waiting:
            decoded = field.decode([[texts[i][a:b] for a, b in places] for i, places in waiting])
            for (i, places), labels in zip(waiting, decoded, strict=True):
                out[i][1].extend(added_spans(texts[i], places, labels, out[i][0]))
            waiting.clear()

    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, list(base)))
        for places in windows(text):
            if len(places) > PIECE:  # on its own, so that one text cannot fill the memory
                labels = field.decode_run([text[a:b] for a, b in places], PIECE)
                out[i][1].extend(added_spans(text, places, labels, base))
                continue
            waiting.append((i, places))
            if len(waiting) >= WINDOWS:
                decode()
    decode()
    return [(base, sorted(every)) for base, every in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def spans(docs: DataFrame, field: RandomField | None = None) -> DataFrame:
    """``docs`` as struct ``row`` with ``base`` and ``spans``: start, end (code points, exclusive) and kind.

    Null and empty texts have no spans; repeated rows are rows of their own; an empty table gives no
    rows; further columns stay inside ``row`` and cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train())  # the size of the labelled table
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list] = ([], [])
            for at in range(0, batch.num_rows, 1024):
                for both in find_spans(batch.column("text").slice(at, 1024).to_pylist(), shared.value):
                    for column, found in zip(columns, both, strict=True):
                        column.append([{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(columns[0], kind), pa.array(columns[1], kind)], names=["row", "base", "spans"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return row.mapInArrow(run, T.StructType([row.schema["row"], *T.StructType.fromDDL(f"base {_SPANS}, spans {_SPANS}").fields]))


def joined_column(name: str):
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(name, part), ",")


def private_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; counts are of base spans."""
    found = spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("row.doc_id", *map(count, KINDS), F.sha2(joined_column("base"), 256).alias("base_sha256"), joined_column("spans").alias("spans"))


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted(found, key=lambda s: (s[0], s[2], s[1])):
        if start >= at:
            out += (text[at:start], f"<{KINDS[kind].upper()}>")
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: RandomField | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars, if there, is counted anew.

    Overlapping spans are one, named after the first.  Texts without spans, null and empty ones too, stay
    as they are, n_chars included; repeated rows are rows of their own, an empty table stays empty, and
    further columns pass through inside a struct.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train())  # the size of the labelled table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean: list[str | None] = []
            whole = text_of_rows(batch.column("row"))
            for at in range(0, batch.num_rows, 1024):
                texts = whole.slice(at, 1024).to_pylist()
                clean += [redact(t, every) if every else None for t, (_, every) in zip(texts, find_spans(texts, shared.value), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(clean, pa.string())], names=["row", "clean"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    made = row.mapInArrow(run, T.StructType([row.schema["row"], T.StructField("clean", T.StringType())]))
    columns = []
    for c, kind in docs.dtypes:
        own = F.col(f"row.`{c}`")
        if c == "text":
            own = F.coalesce("clean", own)
        elif c == "n_chars":
            own = F.coalesce(F.length("clean").cast(kind), own)
        columns.append(own.alias(c))
    return made.select(*columns)
