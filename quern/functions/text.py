"""Scalar text functions as column expressions; none leaves the JVM. Nulls give null unless said otherwise."""

from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column, functions as F

from quern.schema import BAD_TITLE_PATTERN, CATEGORIES, DOI_PATTERN, FAMILIES, MISSING, STOPWORDS

_BLANK = r"[ \t\n\r\f\x0b]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{_BLANK}+", " "))


def tokenise(c: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of letters a-z and digits, without stopwords and one-character words; null gives none."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    dropped = STOPWORDS if stopwords is None else stopwords
    # one search in a text of all stopwords, and only for words short enough to be one
    listing, longest = F.lit(" " + " ".join(dropped) + " "), max(map(len, dropped), default=0)
    return F.filter(words, lambda w: (F.length(w) > 1) & ((F.length(w) > longest) | ~F.contains(listing, F.concat(F.lit(" "), w, F.lit(" ")))))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens; none if there are fewer tokens."""
    if n == 1:
        return F.array_distinct(tokens)
    some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def overlap(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def lexical(a: Column, b: Column) -> Column:
    """Of two token lists: half the mean Jaccard of 1-, 2- and 3-grams, half the overlap of words."""
    grams = [jaccard(ngrams(a, n), ngrams(b, n)) for n in (1, 2, 3)]
    return (reduce(lambda x, y: x + y, grams) / 3 + overlap(ngrams(a, 1), ngrams(b, 1))) / 2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1."""
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def cosine(a: Column, b: Column) -> Column:
    """Not below 0."""
    return F.greatest(F.lit(0.0), F.try_divide(dot(a, b), norm(a) * norm(b)))


def ensemble(lexical_score: Column, semantic_score: Column | None, w_lexical: float, w_semantic: float) -> Column:
    return lexical_score if semantic_score is None else w_lexical * lexical_score + w_semantic * semantic_score


def rescale(c: Column, low: float, high: float) -> Column:
    """From low..high to 0..5, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), (c - low) / (high - low) * 5))


def first_title(c: Column) -> Column:
    """The first level-one heading, or ''."""
    return F.regexp_extract(c, r"(?m)^# ([^\n]+)", 1)


def first_link(c: Column) -> Column:
    return F.regexp_extract(c, r"https?://[^\s\)]+", 0)


def all_titles(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?m)^# ([^\n]+)"), 1)


def all_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(https?://[^\s\)]+)"), 1)


def cut_back_matter(c: Column) -> Column:
    """Without everything from the acknowledgements or references on."""
    return strip(F.regexp_replace(c, r"(?is)### (ACKNOWLEDGMENTS?|REFERENCES?).*", ""))


def markdown(title: Column, link: Column, path: Column, body: Column, stem: Column) -> Column:
    """An article as Markdown with front matter; title falls back to the file's stem, link to NOT FOUND."""
    some = lambda c, other: F.coalesce(F.nullif(strip(c), F.lit("")), other)
    return F.concat_ws("\n", F.concat(F.lit("title: "), some(title, stem)), F.concat(F.lit("link: "), some(link, F.lit("NOT FOUND"))), F.concat(F.lit("path: "), path), F.lit("---"), F.coalesce(body, F.lit("")))


def front_matter(c: Column, key: str) -> Column:
    return strip(F.regexp_extract(F.split(c, "---\n", 2)[0], rf"(?m)^{key}: *(.*)$", 1))


def body(c: Column) -> Column:
    """What follows the first line of dashes; the whole text if there is none."""
    parts = F.split(c, "---\n", 2)
    return F.when(F.size(parts) > 1, parts[1]).otherwise(c)


def yes_no(c: Column) -> Column:
    """The first whole word YES or NO; UNCLEAR without one, for null, and for error messages."""
    word = F.upper(F.regexp_extract(c, r"(?i)\b(YES|NO)\b", 1))
    return F.when(c.isNull() | c.startswith("ERROR:") | (word == ""), "UNCLEAR").otherwise(word)


def category_numbers(c: Column) -> Column:
    """The distinct whole-word numbers 1 to 8, ascending; none for null and error messages."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([1-8])\b"), 1)))
    return F.when(c.isNull() | c.startswith("ERROR:"), F.array().cast("array<string>")).otherwise(found)


def first_binary(c: Column) -> Column:
    """The first 0 or 1 in a text, 0 without one."""
    found = F.regexp_extract(c, "[01]", 0)
    return F.when(found == "1", 1).otherwise(0)


def confidences(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\(Confidence level: ([0-9.]+)\)"), 1), lambda x: x.try_cast("double"))


def coverage(c: Column) -> Column:
    """Numbered lines of an answer."""
    return F.regexp_count(c, F.lit(r"\n\d+\.")).cast("long")


def numbered_lines(c: Column) -> Column:
    """The lines that start with a digit."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: x.rlike("^[0-9]")), "\n")


def plain_ids(c: Column, tokens: list[str] = ("[", "]")) -> Column:
    """Without the tokens that mark reference ids."""
    return reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("")), tokens, c)


def no_newlines(c: Column) -> Column:
    return F.translate(c, "\n\r", "")


def text_exists(c: Column) -> Column:
    """False for null and the words that stand for missing; NO ... FOUND counts as text."""
    return F.coalesce(~F.lower(strip(c)).isin(MISSING), F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("1", "true", "yes", "y", "t"), F.lit(False))


def quality(c: Column, wanted: str) -> Column:
    """Of any, yes or no: whether a value passes; a value that is neither passes only any."""
    bare = F.lower(strip(F.coalesce(c, F.lit(""))))
    words = {"yes": r"^(yes|true|1|high|strong)$", "no": r"^(no|false|0|low|weak)$"}
    return F.lit(True) if wanted == "any" else bare.rlike(words[wanted])


def fraction(c: Column) -> Column:
    """a/b or a number, as a double; else null."""
    parts = F.split(c, "/")
    number = lambda x: F.trim(x).try_cast("double")
    return F.when(F.size(parts) == 2, F.try_divide(number(parts[0]), number(parts[1]))).otherwise(number(c))


def venue_group(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    return F.when(up.contains("ICSE"), "ICSE").when(up.contains("FSE"), "FSE").otherwise("Other")


def family(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda chain, k: chain.when(low.contains(k), k), FAMILIES[1:], F.when(low.contains(FAMILIES[0]), FAMILIES[0])).otherwise("other")


def article_key(venue: Column, title: Column) -> Column:
    return F.concat_ws("||", F.coalesce(venue, F.lit("nan")), F.coalesce(title, F.lit("nan")))


def done_key(path: Column, title: Column) -> Column:
    return F.concat_ws("|||", strip(F.coalesce(path, F.lit(""))), strip(F.coalesce(title, F.lit(""))))


def content_key(*columns: Column) -> Column:
    return F.concat_ws("||", *[F.lower(strip(F.coalesce(c, F.lit("")))) for c in columns])


def merged_text(*columns: Column) -> Column:
    return F.concat_ws(" . ", *[F.nullif(strip(c), F.lit("")) for c in columns])


def stated(c: Column, missing: str = "Not explicitly stated") -> Column:
    """The stripped text, or what stands for a missing one: null, blank or nan."""
    bare = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(bare).isin("", "nan"), missing).otherwise(bare)


def render(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its value; null counts as empty, double braces stand for themselves."""
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [F.coalesce(values[name].cast("string"), F.lit(""))] if name is not None else []
    return F.concat(*parts) if parts else F.lit("")


def category_prompt(actionable: Column, lead: str = "Which of these categories does the recommendation belong to?", ask: str = "Name the numbers only, with commas between them; 0 if there is none.") -> Column:
    """A question whose answer category_numbers reads: the numbered categories, the recommendation, and how to answer."""
    listing = "\n".join(f"  {k}. {c}" for k, c in enumerate(CATEGORIES, 1))
    return render("{lead}\n\n{listing}\n\n{actionable}\n\n{ask}", lead=F.lit(lead), listing=F.lit(listing), actionable=stated(actionable), ask=F.lit(ask))


def judge_prompt(definition: str, actionable: Column, impact: Column, evidence: Column, ask: str = "Does it hold? Answer YES or NO.") -> Column:
    """A question whose answer yes_no reads: a definition, the three fields, and how to answer."""
    return render("{definition}\n\nActionable: {a}\nImpact: {i}\nEvidence: {e}\n\n{ask}", definition=F.lit(definition), a=stated(actionable), i=stated(impact), e=stated(evidence), ask=F.lit(ask))


def canonical_categories(c: Column) -> Column:
    """The canonical names among the parts between bars."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), lambda x: x.isin(CATEGORIES))


def primary_category(c: Column) -> Column:
    """The first part between bars; null for none."""
    first = strip(F.split(c, r"\|")[0])
    return F.when((first != "") & (F.upper(first) != "NONE"), first)


def fuzzy_categories(c: Column, legacy: bool = False) -> Column:
    """The canonical categories that hold, or are held by, a part between ; , or |, letter case aside, in canonical order.
    legacy reads null as the word nan, which occurs within governance."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit("nan" if legacy else ""))), r"[;,|]"), strip), lambda x: x != "")
    names = F.array(*[F.lit(x) for x in CATEGORIES])
    return F.filter(names, lambda n: F.exists(parts, lambda p: F.lower(n).contains(p) | p.contains(F.lower(n))))


def model_present(c: Column, keyword: str) -> Column:
    tokens = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[|,\s'\[\]\"]+")
    return F.exists(tokens, lambda t: t.contains(keyword))


def clean_title(c: Column) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^\*+|\*+$", ""))


def bad_title(c: Column) -> Column:
    t = clean_title(c)
    return (F.length(t) < 6) | t.rlike(BAD_TITLE_PATTERN) | F.replace(t, F.lit("."), F.lit("")).rlike(r"^\d+$")


def doi(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, DOI_PATTERN, 0), r"[.,;)]+$", "")


def author_in_byline(families: Column, page: Column, lines: int = 12) -> Column:
    """Whether one of the family names, of three letters or more, occurs in the page's first lines; false without any."""
    byline = F.lower(F.array_join(F.slice(F.split(F.coalesce(page, F.lit("")), "\n"), 1, lines), "\n"))
    return F.exists(F.coalesce(families, F.array().cast("array<string>")), lambda f: F.coalesce((F.length(F.trim(f)) > 2) & byline.contains(F.lower(F.trim(f))), F.lit(False)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_"), 1, 60)


def latex(c: Column) -> Column:
    for x in "&%_#":
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def percent(count: Column, total: Column) -> Column:
    share = F.coalesce(F.try_divide(count * 100.0, total), F.lit(0.0))
    return F.concat(count.cast("string"), F.lit(" ("), F.format_string("%.2f", share), F.lit("\\%)"))


def fixed(c: Column, digits: int = 3, as_percent: bool = False, pending: str = r"\textcolor{red}{[PENDING]}") -> Column:
    """A number for a table, or what stands for one that is still missing."""
    shown = F.concat(F.format_string("%.1f", c), F.lit("\\%")) if as_percent else F.format_string(f"%.{digits}f", c)
    return F.when(c.isNull() | F.isnan(c), pending).otherwise(shown)


def interpret_kappa(c: Column) -> Column:
    chain = F.when(c.isNull(), "undefined").when(c < 0, "poor")
    for top, name in ((0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial")):
        chain = chain.when(c < top, name)
    return chain.otherwise("almost perfect")


def composite_valid(actionable: Column, evidence: Column, impact: Column) -> Column:
    return F.when((actionable == "YES") & (evidence == "YES") & impact.isin("YES", "N/A"), "YES").otherwise("NO")


def label(c: Column) -> Column:
    """YES, NO or N/A from any spelling; '' for anything else."""
    up = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.when(up.isin("YES", "Y"), "YES").when(up.isin("NO", "N"), "NO").when(up == "N/A", "N/A").otherwise("")
