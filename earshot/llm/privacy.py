"""Personal data, and information-theoretic sanitisation of the terms that reveal it.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these are the protected entities.  What
a term ``t`` discloses of an entity ``e`` is estimated on the whole corpus, as the share of the entity's
information content that their pointwise mutual information makes up::

    PMI(t, e) / IC(e) = 1 + log(n(t, e) / n(t)) / log(N / n(e))

with n the numbers of documents that hold the term, the entity, or the entity with the term within ``reach``
words of it, and N that of all documents: 1 means that whoever reads the term knows the entity.  Near an entity,
a term that discloses more than ``threshold`` of it is generalised, if its general form (digits as 0, else its
first characters) discloses no more than that, and removed otherwise.  A rare name beside an address is what must
not stay, so one text is evidence enough; ``min_texts`` asks for more different texts that hold a pair.

Terms are words of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case.

Defined results: null texts are empty; null ids are rows like others; rows that repeat are reported each and
count as documents each; a corpus of which every document holds the entity has no content to disclose.
Patterns are matched in time linear in the text, however long.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import encoded, kept, normal_words, slices
from earshot.sources.shared import cut, cut_measured

# Fixed values of the base scan: kinds in order, patterns, lengths and limits.
BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile("[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MOST_IP = (13, 19), (9, 15), 255

KINDS = (*BASE_KINDS, "general", "removed")
#: What stands in a sanitised text; a generalised term's place is taken by its general form.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "[REMOVED]"}

_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_DIGITS = re.compile("[0-9]")
_ZEROS = bytes.maketrans(b"123456789", b"000000000")
#: Bytes that a general form keeps of a word without digits.
HEAD = 4

Span = tuple[int, int, str, str]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind, value)`` by kind and start; leftmost and non-overlapping per kind, failing ones dropped."""
    out: list[Span] = [(s, e, "email", text[s:e].lower()) for s, e in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= MOST_IP for p in m[0].split(".")):
            out.append((*m.span(), "ip", m[0]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < CARD_DIGITS[0]:
            continue
        digits = _only_digits(m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
            out.append((*m.span(), "card", digits))
    for m in _PHONE.finditer(text) if "+" in text else ():
        digits = _only_digits(m[0])
        if PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]:
            out.append((*m.span(), "phone", digits))
    return out


def general_form(word: bytes) -> bytes | None:
    """Less than the word says: its digits as 0, else its first characters; null if that is the word itself."""
    if any(48 <= b <= 57 for b in word):
        form = word.translate(_ZEROS)
    else:
        form = word[:HEAD].decode("utf-8", "ignore").encode("utf-8") + b"*"
    return None if form == word or len(word) <= HEAD and form.endswith(b"*") else form


def term_hash(term: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "little", signed=True)


class Terms(dict):
    """Hashes of a word and of its general form (0 for none), remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 1 << 17:
            self.clear()
        form = general_form(word)
        self[word] = found = (term_hash(word), 0 if form is None else term_hash(b"general:" + form))
        return found


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_NEAR = [("entity", pa.int64()), ("term", pa.int64()), ("general", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
_FOUND = [("base", pa.list_(_SPAN)), ("entities", pa.list_(pa.int64())), ("near", pa.list_(pa.struct(_NEAR)))]
_FOUND_SQL = (
    "base array<struct<start:int,end:int,kind:string>>, entities array<bigint>, "
    "near array<struct<entity:bigint,term:bigint,general:bigint,start:int,end:int>>"
)
#: Surroundings that one row holds; a text with more has further rows, whose ``base`` is null.
_MOST_NEAR = 4096


def surroundings(text: str, spans: list[Span], reach: int, terms: Terms) -> Iterator[tuple]:
    """``(entity, term, general, start, end)`` of the words near each base span, each once for an entity."""
    taken = sorted((s, e) for s, e, _, _ in spans)
    words, i, furthest = [], 0, 0
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            furthest, i = max(furthest, taken[i][1]), i + 1
        if m.start() >= furthest:
            words.append((m.start(), m.end(), *terms[normal_words(m[0])[0]]))
    starts = [w[0] for w in words]
    near: dict[int, set[int]] = {}
    for s, e, kind, value in spans:
        a, b = bisect_left(starts, s), bisect_left(starts, e)
        near.setdefault(term_hash(encoded(f"{kind}:{value}")), set()).update(
            [*range(max(0, a - reach), a), *range(b, min(len(words), b + reach))]
        )
    for entity, places in near.items():
        for p in sorted(places):
            yield entity, words[p][2], words[p][3], words[p][0], words[p][1]


def _scan(reach: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = kept(("terms",), Terms)
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                held = 0
                for i, text in enumerate(part.column(0).to_pylist()):
                    spans = base_spans(text or "")
                    base = [{"start": s, "end": e, "kind": k} for s, e, k, _ in spans]
                    entities = sorted({term_hash(encoded(f"{k}:{v}")) for _, _, k, v in spans})
                    near: list[dict] = []
                    for x in surroundings(text, spans, reach, terms) if spans else ():
                        near.append(dict(zip([n for n, _ in _NEAR], x)))
                        if len(near) == _MOST_NEAR:
                            out.append((i, base, entities, near))
                            base, entities, near = None, [], []
                            held += 1
                            if held == 16:
                                yield _rows(part, out)
                                out, held = [], 0
                    if near or base is not None:
                        out.append((i, base, entities, near))
                yield _rows(part, out)

    return scan


def _rows(part: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    """What was found, each with the columns of its row beside the text."""
    at, *columns = zip(*out) if out else [()] * (1 + len(_FOUND))
    rest = [c.take(pa.array(at, pa.int64())) for c in part.columns[1:]]
    found = [pa.array(c, t) for c, (_, t) in zip(columns, _FOUND)]
    return pa.RecordBatch.from_arrays([*rest, *found], [*part.schema.names[1:], *(n for n, _ in _FOUND)])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a slice each term and general form occurs."""
    terms = kept(("terms",), Terms)
    for batch in batches:
        for part in slices(batch):
            held = []
            for text in part.column(0).to_pylist():
                found = {h for w in set(normal_words(text)) for h in terms[w]}
                found.discard(0)
                held.append(np.fromiter(found, np.int64, len(found)))
            keys, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": pa.array(keys), "n": pa.array(n, pa.int64())})


def find_personal_data(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = 8,
    threshold: float = 0.9,
    min_texts: int = 1,
    salts: int = 16,
) -> DataFrame:
    """``(doc_id, base, added)`` per document: spans ``(start, end, kind)`` in code points, by kind and start.

    ``base`` holds the kinds of ``BASE_KINDS``, ``added`` terms to be generalised (``general``) or ``removed``.
    """
    ident = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(
        text.alias("text"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("mark"), F.col(id_col).alias("doc_id")
    )
    scanned = rows.mapInArrow(_scan(reach), f"row bigint, mark bigint, doc_id {ident}, {_FOUND_SQL}")
    found, seen = cut_measured(scanned, "personal", n=F.count("base"))
    near = found.select("row", "mark", F.explode("near").alias("x")).select("row", "mark", "x.*")
    flagged = _revealing(docs.select(F.col(text_col).alias("text")), found, near, seen["n"], threshold, min_texts, salts)
    hit = _spread(near, flagged, ["entity", "term"], ["row", "start"], salts)
    # Near two entities, a word is removed if either of them asks for that.
    spans = hit.groupBy("row", "start", "end").agg(F.max("kind").alias("kind"))
    order = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    added = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    back = F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    base = found.filter(F.col("base").isNotNull()).select("row", "doc_id", "base")
    return base.join(added, "row", "left").select("doc_id", "base", F.coalesce(back, none).alias("added"))


def _spread(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], salts: int) -> DataFrame:
    """The join of rows with a table that has each key once; a key that very many rows share is dealt by ``by``."""
    every = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(every, [*keys, "salt"]).drop("salt")


def _revealing(
    texts: DataFrame, found: DataFrame, near: DataFrame, n_docs: int, threshold: float, min_texts: int, salts: int
) -> DataFrame:
    """``(entity, term, kind)`` of the terms that disclose too much of an entity near them."""
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    words = near.select("row", "mark", "entity", F.col("term").alias("form"), F.lit(False).alias("is_general"))
    forms = near.filter("general <> 0").select("row", "mark", "entity", F.col("general").alias("form"), F.lit(True).alias("is_general"))
    # A row counts once for a pair; counted per text first, copies shrink before they are shuffled.
    per_row = words.unionAll(forms).distinct()
    pairs = per_row.groupBy("entity", "form", "is_general", "mark").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "form", "is_general").agg(F.sum("n").alias("n_pair"), F.count("*").alias("texts"))
    pairs = cut(pairs.filter(F.col("texts") >= min_texts), "pairs")
    wanted = pairs.select(F.col("form").alias("term")).distinct()
    counts = texts.mapInArrow(_count_terms, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_form"))
    counts = counts.join(wanted, "term").withColumnRenamed("term", "form")
    content = F.log(F.lit(float(max(1, n_docs))) / F.col("n_entity"))
    share = 1 + F.log(F.col("n_pair") / F.col("n_form")) / content
    judged = cut(
        _spread(_spread(pairs, counts, ["form"], ["entity"], salts), entities, ["entity"], ["form"], salts).select(
            "entity", "form", "is_general", F.when(content > 0, share).otherwise(0.0).alias("share")
        ),
        "judged",
    )
    above = judged.filter((F.col("share") > threshold) & ~F.col("is_general")).select("entity", F.col("form").alias("term"))
    told = judged.filter(F.col("is_general")).select("entity", F.col("form").alias("general"), F.col("share").alias("general_share"))
    both = near.select("entity", "term", "general").distinct().join(above, ["entity", "term"]).join(told, ["entity", "general"], "left")
    safe = (F.col("general") != 0) & (F.coalesce("general_share", F.lit(1.0)) <= threshold)
    return both.select("entity", "term", F.when(safe, "general").otherwise("removed").alias("kind"))


def sanitised(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with marks for its spans; where spans overlap, one mark of the first stands for all."""
    out, done = [], 0
    for start, end, kind in sorted(spans, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if start >= done:
            word = text[start:end]
            form = general_form(encoded(word).lower()) if kind == "general" else None
            out += [text[done:start], (form or b"").decode("utf-8") if kind == "general" else MARKS[kind]]
        done = max(done, end)
    return "".join(out) + text[done:]


def sanitise_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``find_personal_data`` replaced in its text; rows are matched by their order.

    ``options`` are those of ``find_personal_data``.  A null text stays null.
    """
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    spans = find_personal_data(rows, id_col="_row", text_col=text_col, **options)
    every = F.transform(F.concat("base", "added"), lambda x: x).alias("_spans")
    joined = rows.join(spans.select(F.col("doc_id").alias("_row"), every), "_row", "left")
    names = [*docs.columns, "_spans"]
    at = names.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [
                    t if t is None or not found else sanitised(t, [(x["start"], x["end"], x["kind"]) for x in found])
                    for t, found in zip(part.column(at).to_pylist(), part.column(len(names) - 1).to_pylist())
                ]
                columns = [*part.columns[:at], pa.array(texts, part.schema.types[at]), *part.columns[at + 1 : -1]]
                yield pa.RecordBatch.from_arrays(columns, names[:-1])

    return joined.select(*names).mapInArrow(clean, docs.schema)
