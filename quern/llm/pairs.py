"""Defective prompt and response pairs, each with the type of its defect.

One pass reads each pair: the answer's structure (JSON, Python repr, a bare list, or plain lines, fenced or not) is
scanned for its texts and for whether it closes. Then, in this order:
- empty: no text but placeholders (an open structure without text is truncated);
- copied: at least `copy_share` of the prompt's five-word windows occur in the answer (of a prompt of fewer words, the
  answer is the prompt);
- refusal: see below;
- truncated: the structure stays open, or the last text doesn't end as texts end;
- language: most of the letters are of another script than most of the prompt's, or the texts are of another language,
  see below.

Refusals: an answer's statement is the first record's texts but for its evidence, which someone else said, or the plain
lines up to a list. Its clauses (between punctuation marks; quotations and clauses that occur in the prompt left out) are
its openings. An answer is bare when it has nothing but its statement: one text, the fields message and error only, or
plain lines without a list. The clauses of bare answers are clustered with one another: MinHash of five-word shingles in
bands, a band's members verified against one another at a similarity of 0.8 (none that could add a link is left out),
linked clauses joined. A cluster is a template of refusal when bare answers to at least `recurs` different prompts hold it
and at least `bare_share` of all answers that open with one of its clauses are bare: what recurs whatever was asked, and
never leads to a record, says no. Advice that recurs comes with its records, and what is taken from the passage is no
clause. An answer that doesn't go on to advise is a refusal when at least a quarter (`bare_words`) of the words of its statement
lie in templates if it is bare, and half (`own_words`) if not, by themselves or without a leading word. No list of phrases takes part; fixed messages (`message`) are sound.

Languages are learned from the pairs: all distinct prompts and answers of 120 characters and more are clustered by character
trigrams, and the clusters' trigram frequencies become the languages. All pairs are then judged: an answer is of another language when it is at least exp(margin) times as likely in some language than in the
prompt's, or fits the prompt's language far less well than texts of its length do (a language nobody asked in).

Defined cases: a null answer is empty; with a null or empty prompt nothing is copied and no language differs; rows with
a null id are left out; a repeated id is judged row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern import runtime
from quern.llm.languages import LEAST, describe, learn
from quern.llm.neardup import _lists, components, minhash_keys

_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[\[\]{}:,]|[^\s\[\]{}:,'\"]+|['\"]", re.S)
_FENCE = re.compile(r"^```[a-zA-Z]*\s*|\s*```$")
_WORD_GAP = re.compile(r"[\W_]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S)
_PLACEHOLDER = re.compile(r"(?:no [A-Z ]* ?found|n/?a|none|null|nan|undefined|unknown|see above|[\W_]*)", re.I)
#: Messages that stand for a sound answer without content.
_FIXED_MESSAGE = re.compile(r"NO ACTIONABLE[A-Z ]*|PARTIAL READ[A-Z ]*|NO [A-Z ]*(?:FOUND|DERIVED)", re.I)
_FIELDS = {"recommendation", "positive_impact", "evidence", "message", "error"}
_SPEECH = {"message", "error"}
_ENDS = set(".!?)]}\"'…»”’。！？）】」%*`>")
_LIST_LINE = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»")
_CLAUSE = re.compile(r"[.!?;:,…。！？；：，、\n()\[\]–—]+")
#: Characters that are words of their own, as their scripts don't part words by blanks.
_WIDE = re.compile(r"([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")
#: Odd multiplier of the rolling hash of five words.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def of(m: re.Match) -> str:
        code = m[1] or m[2]
        return chr(int(code, 16)) if code else {"n": "\n", "t": "\t", "r": "\r"}.get(m[3], m[3])

    return _ESCAPE.sub(of, text)


def normal(text: str) -> str:
    return _WORD_GAP.sub(" ", text.lower()).strip()


def words_of(text: str) -> list[str]:
    """The normalised text's words; characters of scripts without blanks count as words."""
    return (text if text.isascii() else _WIDE.sub(r" \1 ", text)).split()


def read_answer(answer: str) -> tuple[list[str], bool, bool]:
    """(texts, whether a structure stays open, whether the texts are the lines of plain text)."""
    texts, _, is_open, plain = read_fields(answer)
    return texts, is_open, plain


def read_fields(answer: str) -> tuple[list[str], list[str], bool, bool]:
    """As read_answer, with the field of each text ('' without one) after the texts."""
    bare = answer.strip()
    if bare.startswith("```"):
        shut = bare.endswith("```") and len(bare) > 5
        bare = _FENCE.sub("", bare).strip()
    else:
        shut = True
    if bare[:1] in ("{", "["):
        tokens = _TOKEN.findall(bare)
        depth, open_text, texts, fields, key, n = 0, False, [], [], None, len(tokens)
        for i, t in enumerate(tokens):
            c = t[0]
            if c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
            elif c in "'\"":
                if len(t) == 1:
                    open_text = True
                    texts.append(_unescape(" ".join(tokens[i + 1 :])))
                    fields.append((key or "").lower())
                    break
                if i + 1 < n and tokens[i + 1] == ":":
                    key = t[1:-1]
                elif key is None or key.lower() in _FIELDS:
                    texts.append(_unescape(t[1:-1]))
                    fields.append((key or "").lower())
        return texts, fields, open_text or depth > 0 or not shut, False
    if len(bare) > 1 and bare[0] == bare[-1] and bare[0] in "'\"":
        bare = bare[1:-1]
    lines = [x for x in bare.split("\n") if x.strip()]
    return lines, [""] * len(lines), not shut and bool(bare), True


def _is_text(text: str) -> bool:
    return _PLACEHOLDER.fullmatch(text.strip()) is None


@dataclass
class Reading:
    """What one answer is, before other answers are looked at."""

    defect: str | None
    clauses: list[str] | None = None  # of the statement, without those of the prompt; None where it isn't judged
    weights: list[int] | None = None  # their words
    n_words: int = 0  # of all clauses of the statement
    bare: bool = False
    advises: bool = False
    flat: str = ""  # all texts, normalised
    asked: str = ""  # the prompt, normalised
    told: bool = False  # whether a language is to be told


def _windows(words: list[str]) -> np.ndarray:
    """Hashes of all runs of five words."""
    if len(words) < 5:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = np.zeros(len(h) - 4, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(5):
            out = out * _STEP + h[k : len(h) - 4 + k]
    return out


def copied(asked: list[str], said: list[str], copy_share: float) -> bool:
    if len(asked) < 5:
        return bool(asked) and asked == said
    # each window of the prompt that occurs begins with a word that does
    least, there = copy_share * (len(asked) - 4), set(said)
    if len(said) < least or sum(w in there for w in asked) < least:
        return False
    return float(np.isin(_windows(asked), _windows(said)).mean()) >= copy_share


def _unfinished(text: str) -> bool:
    text = text.rstrip()
    return text[-1] not in _ENDS and not _FIXED_MESSAGE.fullmatch(text)


def read_pair(prompt: str | None, answer: str | None, copy_share: float) -> Reading:
    asked = normal(prompt) if prompt else ""
    if answer is None:
        return Reading("empty", asked=asked)
    texts, fields, is_open, plain = read_fields(answer)
    fields = [f for x, f in zip(texts, fields) if _is_text(x)]
    texts = [x for x in texts if _is_text(x)]
    if not texts:
        return Reading("truncated" if is_open else "empty", asked=asked)
    flat = normal("\n".join(texts))
    if asked and copied(words_of(asked), words_of(flat), copy_share):
        return Reading("copied", flat=flat, asked=asked)
    if len(texts) == 1 and _FIXED_MESSAGE.fullmatch(texts[0].strip()):
        return Reading("truncated" if is_open else None, flat=flat, asked=asked)
    # where no text of several ends as texts end, that is the answer's style
    loose = len(texts) > 1 and all(map(_unfinished, texts))
    broken = is_open or _unfinished(texts[-1]) and not loose
    if plain:
        first = next((k for k, x in enumerate(texts) if _LIST_LINE.match(x)), len(texts))
        advises = bare = False
        if first == 0:
            said, advises = [_LIST_LINE.sub("", texts[0])], len(texts) > 1
        else:
            said, advises, bare = texts[:first], first < len(texts), first == len(texts)
    else:
        speech = all(f in _SPEECH for f in fields)
        said = texts if speech else texts[:1]
        bare = speech or len(texts) == 1
        advises = not speech and any(f in fields[:k] for k, f in enumerate(fields))
    whole = "\n".join(said)
    own = _QUOTED.sub(" ", whole)  # what is quoted is said by someone else, unless all of it is
    parts = [normal(x) for x in _CLAUSE.split(own if _WORD_GAP.sub("", own) else whole)]
    parts = [x for x in parts if x]
    if broken and parts and len(said) == len(texts):
        parts.pop()  # breaks off
    size = {x: len(words_of(x)) for x in parts}
    padded = f" {asked} "
    clauses = [x for x in size if f" {x} " not in padded]
    return Reading("truncated" if broken else None, clauses, [size[x] for x in clauses], sum(size.values()), bare and not broken, advises, flat, asked, bool(flat and asked) and not broken)


def _shingles(clause: str) -> list[str]:
    words = words_of(clause)
    return [" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))]


def _hashes(clauses: list[str]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    sets = [sorted({xxhash.xxh64_intdigest(s) for s in _shingles(o)}) for o in clauses]
    return np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64), np.array([h for s in sets for h in s], np.uint64)


def _similar(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets a[i] and b[i] reach the similarity; rows are padded, in a by 0 and in b by 1."""
    both = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
    return both >= similarity * (size_a + size_b - both) - 1e-9


def band_links(key: np.ndarray, oid: np.ndarray, offsets: np.ndarray, values: np.ndarray, similarity: float, small: int = 32) -> np.ndarray:
    """Links (oid, oid) that join, within each key (ascending), all members which pairs of the similarity connect. In small
    bands all pairs are verified; in larger ones each member is verified against all that nothing has reached yet, so a
    template of m members costs m verifications, and m members unlike one another m * (m - 1) / 2."""
    size = np.diff(offsets)
    inside = np.arange(size.max(initial=1)) < size[:, None]
    a, b = np.zeros(inside.shape, np.uint64), np.ones(inside.shape, np.uint64)
    a[inside] = b[inside] = values
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    width = np.diff(np.append(first, len(key)))
    few = np.repeat(width <= small, width)
    found = [np.zeros((0, 2), np.int64)]
    pairs = [np.zeros((0, 2), np.int64)]
    for d in range(1, small):
        at = np.flatnonzero(few[:-d] & (key[:-d] == key[d:])) if d < len(key) else []
        if not len(at):
            break
        pairs.append(np.stack((at, at + d), axis=1))
    pairs = np.concatenate(pairs)
    # a pair of several bands is verified once
    names = np.stack((np.minimum(oid[pairs[:, 0]], oid[pairs[:, 1]]), np.maximum(oid[pairs[:, 0]], oid[pairs[:, 1]])), axis=1)
    pairs = pairs[np.unique(names, axis=0, return_index=True)[1]] if len(pairs) else pairs
    for i in range(0, len(pairs), 20_000):
        x, y = pairs[i : i + 20_000].T
        good = _similar(a[x], b[y], size[x], size[y], similarity)
        found.append(np.stack((oid[x[good]], oid[y[good]]), axis=1))
    for begin, n in zip(first[width > small], width[width > small]):
        s, codes = size[begin : begin + n], np.zeros((n, a.shape[1]), np.int64)
        codes[inside[begin : begin + n]] = np.unique(a[begin : begin + n][inside[begin : begin + n]], return_inverse=True)[1] + 1
        marked = np.zeros(codes.max() + 1, bool)
        left, reached = np.arange(n), []
        while len(left):
            if not reached:
                reached, left = [left[0]], left[1:]
            x = reached.pop()
            marked[codes[x]] = True
            marked[0] = False
            both = marked[codes[left]].sum(axis=1)
            marked[codes[x]] = False
            good = both >= similarity * (s[x] + s[left] - both) - 1e-9
            if good.any():
                y = left[good]
                found.append(np.stack((np.full(len(y), oid[begin + x]), oid[begin + y]), axis=1))
                reached, left = reached + y.tolist(), left[~good]
    found = np.concatenate(found)
    return found[found[:, 0] != found[:, 1]]


def _verified(banded: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """Links (a, b) within the bands of (key, oid, s). The members of a band above `crowd` are first verified against its
    smallest; those that it doesn't reach then meet all members, part by part of `crowd` rows."""
    crowded = banded.groupBy("key").agg(F.count("*").alias("n"), F.min_by("s", "oid").alias("t"), F.min("oid").alias("low")).where(F.col("n") > crowd)
    crowded = runtime.cut(crowded)
    rest, direct = banded, None
    if crowded.count():
        met = banded.join(crowded, "key")
        both = F.size(F.array_intersect("s", "t"))
        alike = both >= F.lit(similarity) * (F.size("s") + F.size("t") - both) - 1e-9
        met = runtime.cut(met.select("key", "oid", "s", "low", "n", alike.alias("alike")))
        direct = met.where("alike and oid != low").select(F.col("oid").alias("a"), F.col("low").alias("b"))
        parts = lambda n: F.ceil(n / crowd).cast("int")
        missed = met.where("not alike").groupBy("key").agg(F.count("*").alias("missed"))
        met = met.join(missed, "key").withColumns({"own": F.xxhash64("oid"), "of": parts(F.col("missed")), "to": parts(F.col("n"))})
        tile = lambda i, j: F.xxhash64("key", i.cast("int"), j.cast("int")).alias("key")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("x")
        fails = met.where("not alike").select("*", every("to")).select(tile(F.pmod("own", "of"), F.col("x")), "oid", "s")
        others = met.select("*", every("of")).select(tile(F.col("x"), F.pmod("own", "to")), "oid", "s")
        rest = banded.join(crowded.select("key"), "key", "left_anti").unionByName(fails).unionByName(others)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = t["key"].to_numpy()
            same = key[1:] == key[:-1]
            keep = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
            if not len(keep):
                return
            t = t.take(pa.array(keep)).combine_chunks()
            links = band_links(key[keep], t["oid"].to_numpy(), *_lists(t["s"].combine_chunks()), similarity)
            for i in range(0, len(links), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(links[i : i + 50_000, k]) for k in (0, 1)], names=["a", "b"])

        held: pa.Table | None = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < 60_000:
                continue
            key = held["key"].to_numpy()
            end = int(np.searchsorted(key, key[-1]))  # the last band may go on
            yield from run(held.slice(0, end)) if end else ()
            held = held.slice(end)
        if held is not None and held.num_rows:
            yield from run(held)

    shards = max(runtime.slices(banded.sparkSession), 12)
    links = rest.select("key", "oid", "s").repartition(shards, "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")
    return (links if direct is None else links.unionByName(direct)).distinct()


def broken_pairs(
    df: DataFrame,
    id_col: str = "response_id",
    prompt_col: str = "prompt",
    answer_col: str = "answer",
    copy_share: float = 0.6,
    similarity: float = 0.8,
    recurs: int = 3,
    bare_share: float = 0.8,
    bare_words: float = 0.25,
    own_words: float = 0.5,
    bands: int = 12,
    rows: int = 3,
    margin: float = 20.0,
) -> DataFrame:
    """(id, defect) of each defective pair."""
    spark = df.sparkSession
    runtime.ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                found = [read_pair(p, a, copy_share) for p, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                rid = pa.array(np.arange(number, number + len(found)) | part << 36)
                number += len(found)
                columns = [pa.array([getattr(x, k) for x in found], kind) for k, kind in (*kinds.items(), *texts.items())]
                yield pa.RecordBatch.from_arrays([rid, b.column(0), b.column(3), *columns], names=["rid", "id", "asked", *kinds, "prompt", "answer", "told"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                m = languages.value.measure(*(b[k].to_pylist() for k in ("prompt", "answer", "told")))
                columns = [pa.array(m[k].astype(kind)) for k, kind in measures.items()]
                yield pa.RecordBatch.from_arrays([*(b[k] for k in carried), *columns], names=[*carried, *measures])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = languages.value.differs({k: b[k].to_numpy(zero_copy_only=False) for k in measures}, margin) & b["told"].to_numpy(zero_copy_only=False)
            b = b.set_column(b.schema.get_field_index("defect"), "defect", pc.if_else(pa.array(differ), "language", b["defect"]))
            yield b.select(plain).filter(pc.or_(b["defect"].is_valid(), pc.greater(pc.fill_null(pc.list_value_length(b["clauses"]), 0), 0)))

    kinds = {"defect": pa.string(), "clauses": pa.list_(pa.string()), "weights": pa.list_(pa.int32()), "n_words": pa.int32(), "bare": pa.bool_(), "advises": pa.bool_()}
    texts = {"asked": pa.string(), "flat": pa.string(), "told": pa.bool_()}
    measures = {"script": "bool", "own": "int32", "n_p": "int64", "fit_p": "float64", "best": "int32", "n_a": "int64", "fit_a": "float64", "fit": "float64", "gap": "float64"}
    plain = ["rid", "id", "asked", *kinds]
    carried = [*plain, "told", "h_p", "h_a"]
    kind = df.schema[id_col].dataType.simpleString()
    fields = f"rid long, id {kind}, asked long, defect string, clauses array<string>, weights array<int>, n_words int, bare boolean, advises boolean"
    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), prompt_col, answer_col, F.xxhash64(prompt_col).alias("asked"))
    hashed = {h: F.when(F.length(t) >= LEAST, F.xxhash64(t)) for h, t in (("h_p", "prompt"), ("h_a", "answer"))}  # null: not learned from
    pairs = runtime.cut(source.mapInArrow(read, f"{fields}, prompt string, answer string, told boolean").withColumns(hashed))
    long_texts = pairs.select(F.col("h_p").alias("h"), F.col("prompt").alias("t")).unionByName(pairs.select(F.col("h_a").alias("h"), F.col("answer").alias("t")))
    learned = learn(long_texts.where("h is not null"))
    languages = spark.sparkContext.broadcast(learned)
    measured = runtime.cut(pairs.mapInArrow(measure, f"{fields}, told boolean, h_p long, h_a long, script boolean, own int, n_p long, fit_p double, best int, n_a long, fit_a double, fit double, gap double"))
    fits = [measured.where(f"{h} is not null and {n} > 0").select(F.col(h).alias("h"), F.col(k).alias("language"), F.col(fit).alias("fit")) for h, n, k, fit in (("h_p", "n_p", "own", "fit_p"), ("h_a", "n_a", "best", "fit_a"))]
    languages = spark.sparkContext.broadcast(describe(learned, fits[0].unionByName(fits[1])))
    judged = runtime.cut(measured.mapInArrow(judge, fields))
    # the clauses of bare answers, with the prompts they answer, and how many other answers open with them
    said = judged.where("clauses is not null").select("bare", "asked", F.col("defect").isNull().alias("whole"), F.explode("clauses").alias("clause")).withColumn("cid", F.xxhash64("clause"))
    bare = runtime.cut(said.where("bare and whole").groupBy("cid", "asked").agg(F.count("*").alias("n"), F.first("clause").alias("clause")))
    clauses = runtime.cut(bare.groupBy("cid").agg(F.first("clause").alias("clause"), F.sum("n").alias("n_bare")))
    other = said.where("not bare").groupBy("cid").agg(F.count("*").alias("n_other")).join(clauses.select("cid"), "cid", "left_semi")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                offsets, values = _hashes(b.column(1).to_pylist())
                key = minhash_keys(offsets, values, bands, rows).view(np.int64)
                of = np.repeat(np.arange(b.num_rows), bands)
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), b.column(0).take(pa.array(of)), sets.take(pa.array(of))], names=["key", "oid", "s"])

    banded = runtime.cut(clauses.select("cid", "clause").mapInArrow(keys, "key long, oid long, s array<long>"))
    group = components(_verified(banded, similarity, crowd=4096))
    member = clauses.join(group.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    member = runtime.cut(member.join(other, "cid", "left").select("cid", "clause", "root", "n_bare", F.coalesce("n_other", F.lit(0)).alias("n_other")))
    prompts = bare.select("cid", "asked").join(member.select("cid", "root"), "cid").select("root", "asked").distinct().groupBy("root").agg(F.count("*").alias("prompts"))
    template = member.groupBy("root").agg(F.sum("n_bare").alias("n_bare"), F.sum("n_other").alias("n_other")).join(prompts, "root")
    template = template.where((F.col("prompts") >= recurs) & (F.col("n_bare") >= bare_share * (F.col("n_bare") + F.col("n_other"))))
    refusing = runtime.cut(member.join(template.select("root"), "root", "left_semi").select("cid"))
    # an answer's own clauses, each also without its leading word, so that a courtesy doesn't hide a template
    open_ = judged.where("clauses is not null and not advises")
    each = open_.select("rid", "id", "n_words", "bare", F.explode(F.arrays_zip("clauses", "weights")).alias("c")).select("rid", "id", "n_words", "bare", F.col("c.clauses").alias("clause"), F.col("c.weights").alias("w"))
    forms = F.array_distinct(F.array("clause", F.when(F.col("w") > 4, F.regexp_replace("clause", r"^\S+ ", "")).otherwise(F.col("clause"))))
    met = each.select("rid", "id", "n_words", "bare", "clause", "w", F.explode(forms).alias("form")).withColumn("cid", F.xxhash64("form")).join(refusing, "cid", "left_semi")
    refused = met.groupBy("rid", "id", "n_words", "bare", "clause").agg(F.max("w").alias("w")).groupBy("rid", "id", "n_words", "bare").agg(F.sum("w").alias("w"))
    least = F.when(F.col("bare"), F.col("n_words") * bare_words).otherwise(F.col("n_words") * own_words)
    refused = runtime.cut(refused.where(F.col("w") >= least).select("rid", "id"))
    others = judged.where("defect is not null").select("rid", "id", "defect").join(refused.select("rid"), "rid", "left_anti")
    return others.select(F.col("id").alias(id_col), "defect").unionByName(refused.select(F.col("id").alias(id_col), F.lit("refusal").alias("defect")))
