"""Quality rules with distribution divergence, as DataFrame expressions only.

Base statistics are exact counts over the whole text. On top, a document's
histograms of character classes and of common words are compared with those of
its language by Jensen-Shannon distance. The language references are sums over
all documents of the language, so they need a grouped aggregation of a narrow
table; they are as many rows as there are listed languages. They are made anew
from the documents that the first ones keep, so that junk doesn't shift what it
is measured against. Documents below the minimum length are not judged by
histograms they are too short to fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, SPACE_CLASS, checkpoint

WINDOW = 5
LEAST_WORDS = 10
#: A document fails if more than this share of its words is in repeated windows.
MOST_REPEATED = 20
#: Words that a histogram must be made of to be compared.
GUARD_WORDS = 40
#: Times that the references are made anew from the documents that the last ones keep.
REFITS = 2
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a document is rejected.
MOST_CLASS_DISTANCE = 0.2
MOST_WORD_DISTANCE = 0.27

#: Function words by language: fixed values.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "ist", "im"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
OTHER = "other"
#: Character classes counted by pattern; lower-case letters and all else are the rest.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "symbol": r"[#*$%&|<>]", "mark": r"[.,;:!?'\"()\-]"}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def starts(s: Column) -> Column:
            again = lambda x, i: (F.get(s, i + 1)["h"].eqNullSafe(x["h"])) | ((i > 0) & F.get(s, F.greatest(i - 1, F.lit(0)))["h"].eqNullSafe(x["h"]))
            return F.sort_array(F.transform(F.filter(s, again), lambda x: x["p"]))

        def spread(p: Column) -> Column:
            # a window reaches to the next one or over its own length
            steps = F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(placed, starts), spread))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def _common_counts(words: Column, lang: Column) -> Column:
    """How often each common word of the document's language occurs; null for other languages."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    hits = F.filter(F.transform(words, F.lower), lambda w: w.isin(every))
    # each hit between two spaces of its own, so that neighbours don't share one
    joined = F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" "))
    lists = F.lit(None).cast("array<string>")
    for name, ws in COMMON_WORDS.items():
        lists = F.when(lang == name, F.array(*[F.lit(f" {w} ") for w in ws])).otherwise(lists)
    count = lambda j, w: ((F.octet_length(j) - F.octet_length(F.replace(j, w, F.lit("")))) / F.octet_length(w)).cast("long")
    return let(joined, lambda j: F.transform(lists, lambda w: count(j, w)))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The id as doc_id, lang (a listed one or ``other``), the base counts, class counts and common-word counts of every row."""
    lang = F.when(F.col(lang_col).isin(list(COMMON_WORDS)), F.col(lang_col)).otherwise(OTHER)
    split = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    split = split.withColumn("_words", words_of(F.col("_text")))
    words, text = F.col("_words"), F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    counted = {c: F.regexp_count(text, F.lit(p)).cast("long") for c, p in CLASSES.items()}
    return split.select(
        "doc_id",
        "lang",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        *[c.alias(f"_{n}") for n, c in counted.items()],
        _common_counts(words, F.col("lang")).alias("_common"),
    )


def _js_distance(p: Iterable[Column], q: Iterable[float]) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram of columns from one of numbers; both sum to 1."""
    total = F.lit(0.0)
    for a, b in zip(p, q, strict=True):
        m = (a + F.lit(float(b))) / 2
        total = total + F.when(a > 0, a * F.log2(F.try_divide(a, m))).otherwise(F.lit(0.0))
        if b > 0:
            total = total + F.lit(float(b)) * F.log2(F.try_divide(F.lit(float(b)), m))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _class_histogram() -> list[Column]:
    """Counts of upper, digit, symbol, mark and of the other characters in words."""
    named = [F.col(f"_{c}") for c in CLASSES]
    rest = F.greatest(F.col("word_chars") - sum(named[1:], named[0]), F.lit(0))
    return [*named, rest]


def _word_histogram(width: int) -> list[Column]:
    """Counts of each common word and of all other words."""
    hits = F.aggregate("_common", F.lit(0).cast("long"), lambda a, x: a + x)
    return [*(F.get("_common", F.lit(i)) for i in range(width)), F.col("n_words") - hits]


def language_references(stats: DataFrame) -> dict[str, tuple[list[float] | None, list[float] | None]]:
    """Class and common-word histograms by language, from all rows of ``stats``; one row a listed language."""
    width = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(c).alias(f"c{i}") for i, c in enumerate(_class_histogram())]
    sums += [F.sum(c).alias(f"w{i}") for i, c in enumerate(_word_histogram(width))]
    found = {}
    for row in stats.groupBy("lang").agg(*sums).collect():
        classes = [row[f"c{i}"] or 0 for i in range(len(CLASSES) + 1)]
        n = len(COMMON_WORDS.get(row["lang"], []))
        words = [row[f"w{i}"] or 0 for i in (*range(n), width)] if n else []
        share = lambda xs: [x / sum(xs) for x in xs] if sum(xs) else None
        found[row["lang"]] = (share(classes), share(words))
    return found


def _with_distances(stats: DataFrame, references: dict) -> DataFrame:
    classes, size = _class_histogram(), F.col("word_chars")
    class_distance = word_distance = F.lit(None).cast("double")
    for lang, (c, w) in references.items():
        if c:
            class_distance = F.when(F.col("lang") == lang, _js_distance([F.try_divide(x, size) for x in classes], c)).otherwise(class_distance)
        if w:
            words = [F.try_divide(x, F.col("n_words")) for x in _word_histogram(len(w) - 1)]
            word_distance = F.when(F.col("lang") == lang, _js_distance(words, w)).otherwise(word_distance)
    enough = F.col("n_words") >= GUARD_WORDS
    return stats.withColumn("class_distance", F.when(enough, class_distance)).withColumn("word_distance", F.when(enough, word_distance))


def _far() -> Column:
    return (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, base_failed, class_distance, word_distance and kept of every row.

    Distances are null where a guard holds them back: fewer than 40 words, or a
    language that isn't listed (word_distance only; such documents share one
    class reference). Null and empty texts have no words and fail. Repeated rows
    are judged alike; columns other than the three named ones are not read.
    """
    stats = checkpoint(text_statistics(docs, id_col, text_col, lang_col))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    sound = stats.where(~failed)
    references = language_references(sound)
    for _ in range(REFITS):
        kept = _with_distances(sound, references).where(~_far())
        references |= {lang: r for lang, r in language_references(kept).items() if r[0]}
    return _with_distances(stats, references).select(
        "doc_id",
        "n_words",
        "word_chars",
        F.col("_symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~_far()).alias("kept"),
        "class_distance",
        "word_distance",
    )


def oracle_sql() -> str:
    """The registered query in DuckDB SQL; the references are made anew by one more round of common table expressions each."""
    lists = " ".join("WHEN '{}' THEN [{}]".format(k, ", ".join(f"'{w}'" for w in ws)) for k, ws in COMMON_WORDS.items())
    known = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    classes = ", ".join("length(regexp_replace(s, '[^{}]', '', 'g'))".format(p.strip("[]").replace("'", "''")) for p in CLASSES.values())
    part = "CASE WHEN {a} > 0 THEN {a} * log2({a} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    js = f"sqrt(greatest(list_sum(list_transform(list_zip({{p}}, {{q}}), lambda z: {part.format(a='z[1]')} + {part.format(a='z[2]')})) / 2, 0))"
    share = "list_transform({x}, lambda v: v / {n}::DOUBLE)"
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    k = max(map(len, COMMON_WORDS.values())) + 1
    refs = f"SELECT lang, list_transform(c, lambda v: v / list_sum(c)::DOUBLE) AS c, CASE WHEN lang <> 'other' THEN list_transform(w, lambda v: v / list_sum(w)::DOUBLE) END AS w FROM (SELECT lang, {sums('cl', len(CLASSES) + 1)} AS c, {sums('co', k)} AS w FROM {{src}} GROUP BY lang)"
    dist = f"SELECT b.*, CASE WHEN n_words >= {GUARD_WORDS} THEN {js.format(p=share.format(x='cl', n='word_chars'), q='r.c')} END AS class_distance, CASE WHEN n_words >= {GUARD_WORDS} AND r.w IS NOT NULL THEN {js.format(p=share.format(x='co', n='n_words'), q='r.w')} END AS word_distance FROM {{src}} b LEFT JOIN {{refs}} r USING (lang)"
    near = f"coalesce(class_distance, 0) <= {MOST_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MOST_WORD_DISTANCE}"
    rounds, last = [f"refs0 AS ({refs.format(src='sound')})"], "refs0"
    for i in range(REFITS):
        rounds += [f"dist{i} AS ({dist.format(src='sound', refs=last)})", f"fit{i} AS ({refs.format(src=f'(SELECT * FROM dist{i} WHERE {near})')})"]
        rounds.append(f"refs{i + 1} AS (SELECT o.lang, coalesce(f.c, o.c) AS c, CASE WHEN f.c IS NOT NULL THEN f.w ELSE o.w END AS w FROM {last} o LEFT JOIN fit{i} f USING (lang))")
        last = f"refs{i + 1}"
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, CASE WHEN lang IN ({known}) THEN lang ELSE 'other' END AS lang, coalesce(text, '') AS s FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(s, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT rid, i AS p, ws[i:i + {WINDOW - 1}] AS k FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) u(i)),
dup AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c >= 2),
rep AS (SELECT rid, count(DISTINCT p + j) AS n FROM dup, range(0, {WINDOW}) r(j) GROUP BY rid),
st AS (SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
              [{classes}] AS c4, list_transform(CASE lang {lists} ELSE [] END, lambda c: len(list_filter(ws, lambda x: lower(x) = c))) AS h FROM w LEFT JOIN rep USING (rid)),
base AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, list_concat(c4, [greatest(word_chars - list_sum(c4), 0)]) AS cl, list_concat(h, [n_words - coalesce(list_sum(h), 0)]) AS co FROM st),
sound AS (SELECT * FROM base WHERE NOT base_failed),
{", ".join(rounds)},
final AS ({dist.format(src="base", refs=last)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {near} AS kept, round(class_distance, 9) AS class_distance, round(word_distance, 9) AS word_distance FROM final
"""
