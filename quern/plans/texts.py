"""Text functions over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quern.functions import text as X, udfs
from quern.operators import responses as R, timewindow, validation
from quern.runtime import table
from quern.schema import BAD_TITLE_PATTERN, CATEGORIES, FAMILIES, NAME_LINE_PATTERN, STOPWORDS, find_column, text_of, with_defaults
from quern.sources import readers

TEXTS = ["actionable", "impact", "evidence"]


def tokenise_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "reconciled_actionables").select("row_id", X.tokenise(F.concat_ws(" ", *TEXTS)).alias("t"))
    return r.select("row_id", F.size("t").cast("long").alias("n_tokens"), *[F.size(X.ngrams(F.col("t"), n)).cast("long").alias(f"n{n}") for n in (1, 2, 3)])


def field_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical similarity of the actionable and the evidence of each row, by array expressions."""
    r = table(spark, sf_dir, "reconciled_actionables").select("row_id", X.tokenise(F.col("actionable")).alias("a"), X.tokenise(F.col("evidence")).alias("b"))
    return r.select("row_id", F.round(X.lexical(F.col("a"), F.col("b")), 6).alias("sim"))


def article_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    return d.select("doc_id", X.first_title(t).alias("title"), X.first_link(t).alias("link"), F.length(X.cut_back_matter(t)).cast("long").alias("n_body"), F.size(X.all_links(t)).cast("long").alias("n_links"))


def yes_no_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "responses")
    return r.select("response_id", X.yes_no(F.col("answer")).alias("verdict"), F.array_join(X.category_numbers(F.col("answer")), ",").alias("numbers"), X.first_binary(F.col("answer")).cast("long").alias("binary"))


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "responses").where("answer is not null")
    a = F.col("answer")
    return r.select("response_id", X.coverage(a).alias("coverage"), F.length(X.numbered_lines(a)).cast("long").alias("n_numbered"), F.length(X.no_newlines(a)).cast("long").alias("n_flat"), F.md5(X.numbered_lines(a)).alias("lines_hash"), F.md5(X.plain_ids(a, ["[", "]", "recommendation"])).alias("plain_hash"))


def model_family_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "responses")
    return r.groupBy(X.family(F.col("model_name")).alias("family")).agg(F.count("*").alias("n"))


def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "responses").select("response_id", "model_name", "venue")
    parts = {k: r.where(X.family(F.col("model_name")) == k) for k in ("qwen", "gemma", "mixtral", "gpt", "deepseek")}
    return R.tagged_union(parts).select("response_id", "_model_key")


def article_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "responses")
    return R.first_seen(r, X.article_key(F.col("venue"), F.col("article_title")), "response_id")


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the reconciled table of which no answer by a qwen model is logged."""
    items = table(spark, sf_dir, "reconciled_actionables").select("venue", "article_title").distinct()
    return R.fresh(items, table(spark, sf_dir, "responses").where(X.family(F.col("model_name")) == "qwen"))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.skipped(table(spark, sf_dir, "responses")).groupBy("skip_reason").agg(F.count("*").alias("n"))


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidates(table(spark, sf_dir, "responses")).select("response_id", "pos", "idx", "model_key", "merged_text", "confidence")


def flat_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flat_recommendations(table(spark, sf_dir, "responses"))


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "responses")
    fixed = r.select("response_id", udfs.repair_json("answer").alias("json"))
    return fixed.select("response_id", F.get_json_object("json", "$.message").alias("message"), F.size(F.from_json(F.get_json_object("json", "$.recommendations"), "array<string>")).cast("long").alias("n"))


def label_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of five shapes: an object with noise behind it, an object alone, one that breaks off, plain words with a number,
    and words without any."""
    j = F.format_string('{"reason_for_the_label": "%s", "label": %d}', "event_type", F.col("event_id") % 2)
    plain = F.concat_ws(" ", F.lit("it is"), "event_type", F.col("event_id").cast("string"))
    shapes = [F.concat(j, F.lit(" tail {")), F.concat(F.lit("  "), j), F.substring(j, 1, 40), plain, F.col("event_type")]
    raw = F.element_at(F.array(*shapes), (F.col("event_id") % 5 + 1).cast("int"))
    r = table(spark, sf_dir, "events").select("event_id", raw.alias("j"))
    return r.select("event_id", udfs.longest_json_prefix("j", "j").alias("x")).select("event_id", "x.reason", "x.label")


def props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON between noise, by the fast path alone: first to last brace, no Python."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("noise "), "props", F.lit(" tail")).alias("raw"))
    inner = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    return e.select("event_id", F.get_json_object(inner, "$.k").cast("long").alias("k"))


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU variant, ROUGE-L and sequence ratio of each row's impact against its actionable, and an injected scorer."""
    v = table(spark, sf_dir, "final_set")
    return v.select("row_id", F.round(udfs.bleu4_variant("actionable", "impact"), 6).alias("bleu"), F.round(udfs.rouge_l("impact", "actionable"), 6).alias("rouge_l"), F.round(udfs.sequence_ratio("article_title", "venue"), 6).alias("title_ratio"), F.round(udfs.scorer(_shared_words)("actionable", "impact"), 6).alias("cosine"))


def _shared_words():
    """A stand-in for an embedding model: the cosine of word sets."""
    words = lambda x: set(re.findall(r"[^ \t\n\r\f\v]+", x.lower()))
    return lambda a, b: [len(words(x) & words(y)) / ((len(words(x)) * len(words(y))) ** 0.5 or 1.0) for x, y in zip(a, b)]


def injected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "final_set").where("actionable is not null and impact is not null")
    return v.select("row_id", F.round(udfs.scorer(_shared_words)("actionable", "impact"), 6).alias("cosine"))


def score_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by model (the first that is named) and technique (here the venue's group)."""
    model = F.coalesce(F.element_at(F.filter(F.split(F.lower("models_present"), r"[|,\s'\[\]\"]+"), lambda x: x != ""), 1), F.lit("none"))
    v = table(spark, sf_dir, "final_set").select("row_id", X.family(model).alias("model"), X.venue_group(F.col("venue")).alias("technique"))
    return v.join(text_scores(spark, sf_dir), "row_id").groupBy("model", "technique").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("bleu", "rouge_l", "title_ratio", "cosine")])


def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back from base64: the vector's sum and its first and last numbers, and the length of the text between."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", udfs.encode_vector("embedding").alias("coded"))
    back = e.select("vec_id", F.length("coded").cast("long").alias("n_coded"), udfs.decode_vector("coded").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", "n_coded", F.size("v").cast("long").alias("n"), F.round(total, 5).alias("total"), F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.element_at("v", -1).cast("double"), 6).alias("last"))


def bad_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "validation_sample")
    return r.select("item_id", X.clean_title(F.col("article_title")).alias("title"), X.bad_title(F.col("article_title")).cast("long").alias("bad"), X.doi(F.coalesce("article_link", F.lit(""))).alias("doi"), X.slug(F.coalesce("primary_category", F.lit(""))).alias("slug"), X.safe_name(F.coalesce("venue", F.lit(""))).alias("file"))


def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "reconciled_actionables").select("row_id", "article_title", "models_present", F.concat_ws("\n", *TEXTS, F.lit("Jane Doe and Max Roe")).alias("page"))
    return validation.title_candidates(v, "row_id", "page", "article_title", "models_present").withColumn("line", F.col("line").cast("long"))


def importance_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "final_set")
    c = {"title": F.col("article_title"), "link": F.col("article_link"), "venue": F.col("venue"), "recommendation": F.col("actionable"), "positive_impact": F.col("impact"), "evidence": F.col("evidence"), "confidence_score": F.col("avg_confidence"), "category": F.col("category"), "features": F.col("models_present")}
    j = f.select("row_id", timewindow.record_json(c).alias("j"))
    return j.select("row_id", F.get_json_object("j", "$.importance").cast("long").alias("importance"), F.get_json_object("j", "$.article.venue").alias("venue"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that a category judge and a judge of soundness are asked, hashed."""
    f = table(spark, sf_dir, "final_set")
    c = F.col
    return f.select("row_id", F.md5(X.category_prompt(c("actionable"))).alias("category_hash"), F.md5(X.judge_prompt("A sound one {follows} from its evidence.", c("actionable"), c("impact"), c("evidence"))).alias("judge_hash"))


_FEATURES = ["Review", "Test", "Release", "Security", "Docs"]


class _Keywords:
    """A stand-in for a model: names the features that occur in a text, loosely at first, by name when asked to tidy."""

    def __call__(self, prompts_: list[str]) -> list[str]:
        low = [p.lower() for p in prompts_]
        return [("* " if p.startswith("tidy") else "maybe: ") + ", ".join(f.upper() for f in _FEATURES if f.lower() in p.split(":", 1)[1]) + ", Unknown" for p in low]


def feature_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each actionable by two calls of a stand-in model, as far as they are valid names."""
    f = table(spark, sf_dir, "final_set").select("row_id", "actionable")
    out = R.assign_features(f, "actionable", _Keywords, "assign:", "tidy:", _FEATURES)
    return out.select("row_id", F.array_join("features", ", ").alias("features"))


def resume_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an article's last answer by a qwen model is there: open, failed (no text) or done."""
    key = X.article_key(F.col("venue"), F.col("article_title"))
    items = table(spark, sf_dir, "reconciled_actionables").select(key.alias("article")).distinct()
    log = table(spark, sf_dir, "responses").where(X.family(F.col("model_name")) == "qwen").select(key.alias("article"), "response_id", F.nullif(X.strip(F.col("answer")), F.lit("")).alias("answer"))
    return R.resume(items, log.select("article", F.struct("response_id").alias("at"), F.coalesce("answer", F.lit("ERROR: empty")).alias("answer")), "article", "at").select("article", "status")


def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows still to be scored: without a verdict, of a content that has none yet, the first of each content."""
    s = table(spark, sf_dir, "scored").select("row_id", "actionable", "impact", "evidence", F.when(F.col("sound_verdict").isNull(), "open").otherwise("done").alias("status"))
    return R.pending(s, "row_id", "status", X.content_key(F.col("actionable"), F.col("impact"), F.col("evidence"))).select("row_id")


def article_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together as Markdown with front matter, and read back."""
    t = F.col("text")
    m = table(spark, sf_dir, "documents").select("doc_id", X.markdown(X.first_title(t), X.first_link(t), F.coalesce("venue", F.lit("")), t, F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("m"))
    md = F.col("m")
    return m.select("doc_id", F.length(md).cast("long").alias("n_chars"), X.front_matter(md, "title").alias("title"), X.front_matter(md, "link").alias("link"), X.front_matter(md, "path").alias("path"), F.md5(X.body(md)).alias("body_hash"))


def about_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return readers.about(d, ["Newcomer", "release checklist"], ["text", "source"]).select("doc_id")


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found under synonyms, in a fixed schema, missing ones null, texts never null."""
    f = table(spark, sf_dir, "final_set")
    wanted = {"title": ["title", "Article_Title"], "actionable": ["recommendation", "actionable"], "score": ["confidence_score", "avg_confidence"]}
    named = f.select("row_id", *[F.col(found).alias(k) for k, names in wanted.items() if (found := find_column(f.columns, names))])
    fixed = with_defaults(named, T.StructType.fromDDL("row_id long, title string, actionable string, score double, reviewer string"))
    return fixed.select("row_id", text_of("title").alias("title"), text_of("actionable").alias("actionable"), "score", "reviewer")


def latest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten articles in first-seen order."""
    return article_keys(spark, sf_dir).orderBy("first_row").limit(10)


_F = [feature_assignment, resume_status, pending_rows, article_markdown, about_documents, base_columns, injected_scores, tokenise_ngram_counts, field_similarity, article_parts, yes_no_parse, answer_lines, model_family_route, tagged_union, article_keys, resume_anti_join, skip_reasons, candidate_pool, flat_recommendations, json_repair, label_repair, props_parse, text_scores, score_averages, vector_round_trip, bad_titles, title_candidates, importance_json, prompts, latest_articles]
QUERIES = {f.__name__: f for f in _F}

_STRIP = lambda c: f"regexp_replace({c}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOK = lambda c: f"list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) > 1 AND NOT list_contains([{_STOP}], w))"
_GRAM = lambda t, n: f"list_distinct(list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' ')))"
_FAMILY = "CASE " + " ".join(f"WHEN contains(lower(coalesce(model_name, '')), '{k}') THEN '{k}'" for k in FAMILIES) + " ELSE 'other' END"
_JACCARD = lambda n: f"CASE WHEN len(list_distinct(list_concat({_GRAM('a', n)}, {_GRAM('b', n)}))) = 0 THEN CAST(1.0 AS DOUBLE) ELSE len(list_intersect({_GRAM('a', n)}, {_GRAM('b', n)})) / len(list_distinct(list_concat({_GRAM('a', n)}, {_GRAM('b', n)}))) END"
_KEY = "concat(coalesce(venue, 'nan'), '||', coalesce(article_title, 'nan'))"
_DONE = f"concat({_STRIP('coalesce(venue, chr(39))')}, '|||', {_STRIP('coalesce(article_title, chr(39))')})".replace("chr(39)", "''")
_FIRST = f"SELECT {_KEY} AS article, min(response_id) AS first_row FROM responses GROUP BY 1"
_LISTING = "\n".join(f"  {k}. {c}" for k, c in enumerate(CATEGORIES, 1))
_BLANK = lambda c: f"CASE WHEN coalesce(lower({_STRIP(c)}) IN ('', 'nan'), true) THEN 'Not explicitly stated' ELSE {_STRIP(c)} END"
_CLEAN = _STRIP(f"regexp_replace({_STRIP('coalesce(article_title, chr(39))')}, '^\\*+|\\*+$', '', 'g')").replace("chr(39)", "''")
_CONTENT = "concat_ws('||', " + ", ".join(f"lower({_STRIP(f'coalesce({c}, chr(39)[2:])')})" for c in TEXTS).replace("chr(39)[2:]", "''") + ")"
_NONE = lambda c, other: f"CASE WHEN coalesce({_STRIP(c)}, '') = '' THEN {other} ELSE {_STRIP(c)} END"
_MARKDOWN = rf"""WITH p AS (SELECT doc_id, venue, text, regexp_extract(text, '(?m)^# ([^\n]+)', 1) AS t, regexp_extract(text, 'https?://[^\s\)]+') AS l FROM documents),
m AS (SELECT doc_id, coalesce(text, '') AS body, {_NONE('t', "concat('doc', doc_id)")} AS title, {_NONE('l', "'NOT FOUND'")} AS link, coalesce(venue, '') AS path FROM p)
SELECT doc_id, length(title) + length(link) + length(path) + length(body) + 26 AS n_chars, title, link, {_STRIP('path')} AS path, md5(body) AS body_hash FROM m"""
_BAD = lambda t: f"(length({t}) < 6 OR regexp_matches({t}, '{BAD_TITLE_PATTERN}') OR regexp_matches(replace({t}, '.', ''), '^\\d+$'))"
_CLEANED = lambda c: _STRIP(f"regexp_replace({_STRIP(f'coalesce({c}, chr(39))')}, '^\\*+|\\*+$', '', 'g')").replace("chr(39)", "''")
_NAME = NAME_LINE_PATTERN.replace("'", "''").replace("À-Ý", "\\x{C0}-\\x{DD}").replace("À-ü", "\\x{C0}-\\x{FC}")
_TITLES = f"""WITH v AS (SELECT row_id, {_CLEANED('article_title')} AS t, {_CLEANED('models_present')} AS d, list_transform(string_split(concat_ws(chr(10), actionable, impact, evidence, 'Jane Doe and Max Roe'), chr(10)), lambda x: {_STRIP('x')}) AS ls FROM reconciled_actionables),
u AS (SELECT row_id, ls, unnest(ls) AS s, generate_subscripts(ls, 1) AS k FROM v),
g AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY k) AS n FROM u WHERE length(s) > 15 AND NOT {_BAD(_CLEANED('s'))}),
c AS (SELECT row_id, k - 1 AS line, s, list_filter(ls[k + 1:k + 2], lambda x: regexp_matches(x, '{_NAME}'))[1] AS name FROM g WHERE n <= 5)
SELECT row_id, CAST(-2 AS BIGINT) AS line, t AS query, t AS title FROM v WHERE NOT {_BAD('t')} UNION ALL SELECT row_id, -1, d, d FROM v WHERE NOT {_BAD('d')}
UNION ALL SELECT row_id, line, s, s FROM c UNION ALL SELECT row_id, line, concat(s, ' ', name), s FROM c WHERE name IS NOT NULL"""
_REPAIR = r"""WITH x AS (SELECT response_id, trim(regexp_replace(regexp_replace(regexp_extract(answer, '(?s)\{.*\}'), ':\s*<([^>]+)>', ': "\1"', 'g'), '```(?:json)?', '', 'g')) AS j FROM responses),
y AS (SELECT response_id, j, j <> '' AND json_valid(j) AS good FROM x)
SELECT response_id, CASE WHEN coalesce(good, false) AND j <> '{}' THEN json_extract_string(CASE WHEN good THEN j END, '$.message') ELSE 'NO ACTIONABLE CAN BE DERIVED' END AS message, CASE WHEN good AND json_type(CASE WHEN good THEN j END, '$.recommendations') = 'ARRAY' THEN json_array_length(CASE WHEN good THEN j END, '$.recommendations') END AS n FROM y"""
ORACLES = {
    "tokenise_ngram_counts": f"WITH t AS (SELECT row_id, {_TOK('concat_ws(chr(32), actionable, impact, evidence)')} AS t FROM reconciled_actionables) SELECT row_id, len(t) AS n_tokens, len(list_distinct(t)) AS n1, len({_GRAM('t', 2)}) AS n2, len({_GRAM('t', 3)}) AS n3 FROM t",
    "field_similarity": f"WITH t AS (SELECT row_id, {_TOK('actionable')} AS a, {_TOK('evidence')} AS b FROM reconciled_actionables) SELECT row_id, round((({_JACCARD(1)} + {_JACCARD(2)} + {_JACCARD(3)}) / 3 + CASE WHEN least(len(list_distinct(a)), len(list_distinct(b))) = 0 THEN CAST(0.0 AS DOUBLE) ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / least(len(list_distinct(a)), len(list_distinct(b))) END) / 2, 6) AS sim FROM t",
    "article_parts": rf"SELECT doc_id, regexp_extract(text, '(?m)^# ([^\n]+)', 1) AS title, regexp_extract(text, 'https?://[^\s\)]+') AS link, length({_STRIP(chr(114) + 'egexp_replace(text, ' + chr(39) + '(?is)### (ACKNOWLEDGMENTS?|REFERENCES?).*' + chr(39) + ', ' + chr(39) * 2 + ')')}) AS n_body, len(regexp_extract_all(text, 'https?://[^\s\)]+')) AS n_links FROM documents WHERE text IS NOT NULL",
    "yes_no_parse": r"SELECT response_id, CASE WHEN answer IS NULL OR starts_with(answer, 'ERROR:') OR regexp_extract(answer, '(?i)\b(YES|NO)\b', 1) = '' THEN 'UNCLEAR' ELSE upper(regexp_extract(answer, '(?i)\b(YES|NO)\b', 1)) END AS verdict, CASE WHEN answer IS NULL OR starts_with(answer, 'ERROR:') THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(answer, '\p{L}', 'x', 'g'), '\b([1-8])\b', 1))), ',') END AS numbers, CAST(CASE WHEN regexp_extract(answer, '[01]') = '1' THEN 1 ELSE 0 END AS BIGINT) AS binary FROM responses",
    "answer_lines": r"SELECT response_id, len(regexp_extract_all(answer, '\n\d+\.')) AS coverage, length(array_to_string(list_filter(string_split(answer, chr(10)), lambda x: regexp_matches(x, '^[0-9]')), chr(10))) AS n_numbered, length(replace(replace(answer, chr(10), ''), chr(13), '')) AS n_flat, md5(array_to_string(list_filter(string_split(answer, chr(10)), lambda x: regexp_matches(x, '^[0-9]')), chr(10))) AS lines_hash, md5(replace(replace(replace(answer, '[', ''), ']', ''), 'recommendation', '')) AS plain_hash FROM responses WHERE answer IS NOT NULL",
    "model_family_route": f"SELECT {_FAMILY} AS family, count(*) AS n FROM responses GROUP BY 1",
    "tagged_union": f"SELECT response_id, {_FAMILY} AS _model_key FROM responses WHERE {_FAMILY} IN ('qwen', 'gemma', 'mixtral', 'gpt', 'deepseek')",
    "article_keys": _FIRST,
    "latest_articles": f"SELECT * FROM ({_FIRST}) ORDER BY first_row LIMIT 10",
    "resume_anti_join": f"SELECT DISTINCT venue, article_title FROM reconciled_actionables WHERE {_DONE} NOT IN (SELECT {_DONE} FROM responses WHERE {_FAMILY} = 'qwen')",
    "label_repair": "WITH r AS (SELECT event_id, event_type, event_id % 5 AS k, left(concat('{\"reason_for_the_label\": \"', event_type, '\", \"label\": ', event_id % 2, '}'), 40) AS broken, concat('it is ', event_type, ' ', event_id) AS plain FROM events) SELECT event_id, CASE WHEN k < 2 THEN event_type WHEN k = 2 THEN broken WHEN k = 3 THEN plain ELSE event_type END AS reason, CASE WHEN k < 2 THEN CAST(event_id % 2 AS VARCHAR) WHEN k = 3 THEN coalesce(nullif(regexp_extract(plain, '[01]'), ''), '0') ELSE '0' END AS label FROM r",
    "props_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "vector_round_trip": "SELECT vec_id, 4 * CAST(ceil(len(embedding) * 4 / 3.0) AS BIGINT) AS n_coded, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[-1] AS DOUBLE), 6) AS last FROM embeddings",
    "bad_titles": rf"WITH t AS (SELECT *, {_CLEAN} AS title FROM validation_sample) SELECT item_id, title, CAST(length(title) < 6 OR regexp_matches(title, '(?i)^(microsoft word|untitled|document\d*|\d+)\b') OR regexp_matches(replace(title, '.', ''), '^\d+$') AS BIGINT) AS bad, regexp_replace(regexp_extract(coalesce(article_link, ''), '(?i)10\.\d{{4,9}}/[^\s" + chr(34) + r"<>\]\)]+'), '[.,;)]+$', '') AS doi, regexp_replace(regexp_replace(lower(coalesce(primary_category, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, left(regexp_replace(coalesce(venue, ''), '[^A-Za-z0-9_-]', '_', 'g'), 60) AS file FROM t".replace("{{", "{").replace("}}", "}"),
    "importance_json": r"SELECT row_id, len(list_filter(regexp_split_to_array(coalesce(models_present, ''), '\s+'), lambda x: x <> '')) AS importance, venue FROM final_set",
    "prompts": f"SELECT row_id, md5(concat('Which of these categories does the recommendation belong to?', chr(10), chr(10), '{_LISTING}', chr(10), chr(10), {_BLANK('actionable')}, chr(10), chr(10), 'Name the numbers only, with commas between them; 0 if there is none.')) AS category_hash, md5(concat('A sound one {{follows}} from its evidence.', chr(10), chr(10), 'Actionable: ', {_BLANK('actionable')}, chr(10), 'Impact: ', {_BLANK('impact')}, chr(10), 'Evidence: ', {_BLANK('evidence')}, chr(10), chr(10), 'Does it hold? Answer YES or NO.')) AS judge_hash FROM final_set",
    "feature_assignment": "SELECT row_id, array_to_string(list_filter(" + repr(_FEATURES) + ", lambda f: contains(lower(coalesce(actionable, '')), lower(f))), ', ') AS features FROM final_set",
    "resume_status": f"WITH i AS (SELECT DISTINCT {_KEY} AS article FROM reconciled_actionables), l AS (SELECT {_KEY} AS article, coalesce(arg_max(coalesce({_STRIP('answer')}, ''), response_id), '') AS answer FROM responses WHERE {_FAMILY} = 'qwen' GROUP BY 1) SELECT i.article, CASE WHEN l.article IS NULL THEN 'open' WHEN l.answer = '' OR starts_with(l.answer, 'ERROR:') THEN 'failed' ELSE 'done' END AS status FROM i LEFT JOIN l ON i.article = l.article",
    "pending_rows": f"WITH k AS (SELECT row_id, sound_verdict, {_CONTENT} AS c FROM scored) SELECT min(row_id) AS row_id FROM k WHERE sound_verdict IS NULL AND c NOT IN (SELECT c FROM k WHERE sound_verdict IS NOT NULL) GROUP BY c",
    "article_markdown": _MARKDOWN,
    "about_documents": "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(chr(10), text, source)), 'newcomer') OR contains(lower(concat_ws(chr(10), text, source)), 'release checklist')",
    "base_columns": "SELECT row_id, coalesce(article_title, '') AS title, coalesce(actionable, '') AS actionable, avg_confidence AS score, CAST(NULL AS VARCHAR) AS reviewer FROM final_set",
    "injected_scores": r"WITH w AS (SELECT row_id, list_distinct(list_filter(regexp_split_to_array(lower(actionable), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(impact), '\s+'), lambda x: x <> '')) AS b FROM final_set WHERE actionable IS NOT NULL AND impact IS NOT NULL) SELECT row_id, round(CASE WHEN len(a) * len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / sqrt(len(a) * len(b)) END, 6) AS cosine FROM w",
    "title_candidates": _TITLES,
    "json_repair": _REPAIR,
}
