"""Line-first quality rules, in DataFrame functions only.

Each line of a text is tested by punctuation, navigation and boilerplate rules;
failing lines are removed, and a document that loses too much of its text is
rejected.  All work is done inside the row, so there is no shuffle at all and
no partition depends on a hot source or on copies.

Defined cases: a null or empty text has no words, fails the base rule and is
not kept; its cleaned text is null or empty.  Repeated rows are each judged
alone.  Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import WORD

BLANKS = " \t\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules; all shares are in percent of the words."""

    min_words: int = 50
    max_repeat_pct: int = 50
    min_kept_pct: int = 70
    #: a line must end so (closing quotes and brackets may follow)
    end: str = r"[.!?…:;。！？]+[\"'”’»)\]]*$"
    #: a menu: this many separators, and one for every ``menu_words`` words
    menu_marks: str = "|»›→•"
    menu_min: int = 3
    menu_words: int = 6
    #: a line of few words that begins with a site link
    menu_start: str = (r"(?i)^(home|menu|log ?in|sign ?(in|up)|register|search|next|previous|back to top|skip to content|"
                       r"read more|share|subscribe|contact us|about us|site ?map)\b")
    menu_start_words: int = 6
    #: phrases of boilerplate, in lower case
    boilerplate: tuple[str, ...] = (
        "lorem ipsum", "javascript", "cookie policy", "cookie settings", "use cookies", "uses cookies", "accept cookies",
        "privacy policy", "terms of use", "terms of service", "all rights reserved", "©", "licensed under ",
        "released under the ", "{", "}")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def _without(c: Column, chars: str) -> Column:
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def split_words(text: Column) -> Column:
    """Words of a text: blanks become spaces, and empty pieces go."""
    for x in BLANKS[1:] + "\n":
        text = F.replace(text, F.lit(x), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def repeated_words(words: Column, least_bits: int = 0) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    Windows of one row are sorted as longs (hash prefix, place), so equal ones
    stand side by side; neighbours with equal prefixes are compared as words.
    Should different windows share a prefix (``least_bits`` of a long are the
    place's, the rest the prefix's), the row's windows are sorted as words.
    The union of the repeated windows is then measured along the text.  Every
    array is bound before a loop over it, so that no rewriting of the plan can
    put its evaluation inside the loop.
    """
    def of(w: Column, bits: Column) -> Column:
        prefix = lambda e: F.call_function("shiftright", e, bits)
        at_zero = lambda e: F.call_function("shiftleft", prefix(e), bits)
        place = lambda e: (e - at_zero(e)).cast("int")

        def same(e, other):
            i, j = place(e), place(other)
            return F.coalesce((prefix(e) == prefix(other)) & (F.get(w, i) == F.get(w, j))
                              & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2)), F.lit(False))

        def key(i):
            return at_zero(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))) + i

        def exact() -> Column:
            """Windows as words, for the rare row whose prefixes clash."""
            window = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
            alike = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
            ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))

            def found(s: Column) -> Column:
                hit = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: alike(F.get(s, j), F.get(s, j - 1)))
                return F.sort_array(F.array_distinct(F.flatten(F.transform(hit, lambda j: F.array(F.get(s, j)["i"], F.get(s, j - 1)["i"])))))

            return let(ordered, found)

        def places(s: Column) -> Column:
            near = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: prefix(F.get(s, j)) == prefix(F.get(s, j - 1)))

            def of_near(js: Column) -> Column:
                both = F.flatten(F.transform(js, lambda j: F.array(place(F.get(s, j)), place(F.get(s, j - 1)))))
                clash = F.exists(js, lambda j: ~same(F.get(s, j), F.get(s, j - 1)))
                return F.when(clash, exact()).otherwise(F.sort_array(F.array_distinct(both)))

            return let(near, of_near)

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + x)

        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key))
        return let(windows, lambda s: let(places(s), covered))

    def bound(w: Column) -> Column:
        bits = F.greatest(F.ceil(F.log2(F.size(w) + 2)).cast("int"), F.lit(least_bits))
        return F.when(F.size(w) >= 4, let(bits, lambda b: of(w, b))).otherwise(F.lit(0).cast("bigint"))

    return let(words, bound)


def line_passes(line: Column, r: LineRules) -> Column:
    """All three rules on one line; a line without a word passes (it holds no text)."""
    def rules(t: Column) -> Column:
        marks = F.length(t) - F.length(_without(t, r.menu_marks))
        menu = (marks >= r.menu_min) & (marks * r.menu_words >= _word_count(t))
        link = F.substring(t, 1, 40).rlike(r.menu_start) & (_word_count(t) <= r.menu_start_words)
        ends = t.endswith(".") | t.rlike(r.end)
        return (t == "") | (ends & ~menu & ~link & ~let(F.lower(t), lambda x: reduce(or_, (F.contains(x, F.lit(p)) for p in r.boilerplate))))

    return let(F.btrim(line, F.lit(BLANKS)), rules)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """(doc_id, text, cleaned_text, counts, base_failed, kept) for every row of ``docs``."""
    r = rules or LineRules()
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = base.withColumns({"words": split_words(text),
                              "lines": F.split(text, "\n", -1)})
    full = lambda lines: F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = parts.select(
        "doc_id", "text", F.size("words").cast("bigint").alias("n_words"),
        F.length(_without(text, BLANKS + "\n")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
        let(full(F.col("lines")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        let(F.filter("lines", lambda x: line_passes(x, r)), lambda p: F.struct(
            F.size(p).alias("n"), F.when(F.size(p) < F.size("lines"), F.array_join(p, "\n")).alias("text"))).alias("passed"))
    cut = F.col("passed.text").isNotNull()
    cleaned = counted.withColumn("cleaned_text", F.coalesce("passed.text", "text"))
    judged = cleaned.withColumns({
        "n_kept_lines": F.col("passed.n").cast("bigint"),
        "n_kept_words": F.when(cut, _word_count(F.col("cleaned_text")).cast("bigint")).otherwise(F.col("n_words")),
        "base_failed": (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_pct * F.col("n_words")),
    })
    verdict = ~F.col("base_failed") & (100 * F.col("n_kept_words") >= r.min_kept_pct * F.col("n_words"))
    return judged.withColumn("kept", verdict) \
        .select("doc_id", "text", "cleaned_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "n_lines", "n_kept_lines", "n_kept_words", "kept")


QUERY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                 "n_lines", "n_kept_lines", "n_kept_words"]


def oracle(table: str = "documents", rules: LineRules | None = None, text: bool = False) -> str:
    """The same rules as DuckDB SQL; ``text`` adds the cleaned text."""
    r = rules or LineRules()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    word = q(WORD)
    trimmed = r"regexp_replace(x, '^[\x20\x09\x0B-\x0D]+|[\x20\x09\x0B-\x0D]+$', '', 'g')"
    n = f"len(regexp_extract_all(t, {word}))"
    marks = f"(length(t) - length(translate(t, {q(r.menu_marks)}, '')))"
    ok = (f"(t = '' OR (regexp_matches(t, {q(r.end)}) "
          f"AND NOT ({marks} >= {r.menu_min} "
          f"AND {marks} * {r.menu_words} >= {n}) "
          f"AND NOT (regexp_matches(t, {q(r.menu_start)}) AND {n} <= {r.menu_start_words}) "
          f"AND NOT ({' OR '.join(f'contains(lower(t), {q(p)})' for p in r.boilerplate)})))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(text, '') AS body FROM {table}),
w AS (SELECT rid, unnest(regexp_extract_all(body, {word})) AS word, generate_subscripts(regexp_extract_all(body, {word}), 1) AS i FROM d),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS tri FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM g WHERE tri IS NOT NULL) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM d),
lt AS (SELECT rid, x, i, {trimmed} AS t FROM l),
lr AS (SELECT rid, x, i, t, {ok} AS ok FROM lt),
ls AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE ok) AS n_kept_lines,
  count(*) FILTER (WHERE t <> '') - count(DISTINCT x) FILTER (WHERE t <> '') AS n_dup_lines,
  coalesce(sum(len(regexp_extract_all(x, {word}))) FILTER (WHERE ok), 0) AS n_kept_words,
  string_agg(x, chr(10) ORDER BY i) FILTER (WHERE ok) AS cleaned FROM lr GROUP BY rid),
b AS (SELECT d.rid, doc_id, text, len(regexp_extract_all(body, {word})) AS n_words,
  length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, n_lines, n_kept_lines, n_kept_words,
  CASE WHEN n_kept_lines < n_lines THEN coalesce(cleaned, '') ELSE text END AS cleaned_text
  FROM d JOIN ls USING (rid) LEFT JOIN cov USING (rid)),
j AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words AS base_failed FROM b)
SELECT doc_id, {"text, cleaned_text, " if text else ""}CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_kept_words >= {r.min_kept_pct} * n_words AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_kept_lines AS BIGINT) AS n_kept_lines, CAST(n_kept_words AS BIGINT) AS n_kept_words
FROM j"""
