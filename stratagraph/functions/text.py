"""Full-text postings, phrases and Okapi BM25 ranking."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import stored

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
COLUMNS = ("path", "name", "content")
EXACT, PARTIAL, PATH = 100.0, 25.0, 10.0
NAME_MATCHES = 200
#: Single characters that decompose into an ASCII letter and marks, made by rule.
_PLAIN = {chr(c): d[0] for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c))) != chr(c) and d[0].isascii()}


def folded(text: Column) -> Column:
    """Lower case without diacritics of Latin letters."""
    return F.translate(F.lower(text), "".join(_PLAIN), "".join(_PLAIN.values()))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def postings(texts: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, col, pos, term: one row a token; positions count within a column."""
    split = texts.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("terms")) for c in COLUMNS])).alias("x"))
    return split.select(key, "x.col", F.posexplode("x.terms").alias("pos", "term"))


def phrases(query: str) -> list[list[str]]:
    """White-space parts of the query; each is a phrase of the tokens in it. Parts without a token fall away."""
    import re

    out = []
    for part in query.split():
        plain = "".join(_PLAIN.get(c, c) for c in part.lower())
        if found := [t for t in re.findall(r"[^\W_]+", plain)]:
            out.append(found)
    return out


def once(value: Column, body) -> Column:
    """The body with the value computed once: optimizer rules put columns in the place of their names, but not into a lambda's argument."""
    return F.element_at(F.transform(F.array(value), body), 1)


def phrase_count(terms: Column, phrase: list[str]) -> Column:
    """Occurrences of the phrase in an array of tokens, which must be an argument of once() or a stored column.

    A native scan: each token is compared with the first of the phrase and only then its followers; no postings are joined.
    """

    def begins(t: Column, i: Column) -> Column:
        hit = t == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(terms, i + k) == word, F.lit(False))
        return hit

    return F.size(F.filter(terms, begins))


def phrase_facts(texts: DataFrame, wanted: list[list[str]], key: str) -> DataFrame:
    """key, dl (all tokens), f0, f1 ... (each phrase's occurrences): each text is read and split once."""

    def facts(t: Column) -> Column:
        own = [t[c] for c in COLUMNS]
        counts = [sum((phrase_count(x, p) for x in own), F.lit(0)).alias(f"f{i}") for i, p in enumerate(wanted)]
        return F.struct(sum((F.size(x) for x in own), F.lit(0)).alias("dl"), *counts)

    split = F.struct(*[tokens(F.col(c)).alias(c) for c in COLUMNS])
    # a generated row: filters on the counts can't be pushed below it, where they would split the text again
    return texts.select(key, F.explode(F.array(once(split, facts))).alias("m")).select(key, "m.*")


def bm25(texts: DataFrame, query: str, key: str = "doc_key") -> DataFrame:
    """key, score of rows with all phrases of the query. Phrases don't cross columns; all columns weigh alike.

    One scan counts tokens and phrases by row and is cut (a few numbers a row), as both the numbers of rows, tokens and
    hits, a single row, and the hits themselves, to which it is joined, are read from it.
    """
    wanted = phrases(query)
    if not wanted:
        return texts.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = stored(phrase_facts(texts, wanted, key))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(wanted))])
    return ranked(rows, stats, len(wanted), key)


ROW = ("doc_key", "path", "name")


def keyed(texts: DataFrame) -> DataFrame:
    """Full-text rows with the key of what they stand for: a node, or themselves."""
    return texts.withColumn("doc_key", F.coalesce("node_id", F.concat_ws("\0", "path", "name")))


def indexed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings: term and the row, col, pos; lengths: the row and its tokens dl) of full-text rows, for stored_bm25().

    Postings belong into a table that is sorted by term, from which a search reads its terms alone.
    """
    rows = keyed(texts).withColumn("row_key", F.struct(*ROW))
    return postings(rows, "row_key").select("term", "row_key.*", "col", "pos"), phrase_facts(rows, [], "row_key").select("row_key.*", "dl")


def stored_bm25(found: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """bm25() of the rows (ROW, score) from their index; texts aren't read.

    Each posting of a phrase's word says where the phrase would begin; it occurs where all its words say the same. That
    is one filter on the terms and sums with map-side parts, whatever the number of words; nothing is joined for it.
    """
    wanted = phrases(query)
    if not wanted:
        return lengths.select(*ROW, F.lit(0.0).alias("score")).limit(0)
    terms = sorted({t for p in wanted for t in p})
    places = F.create_map(*[x for t in terms for x in (F.lit(t), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(len(p)).alias("n")) for i, p in enumerate(wanted) for k, w in enumerate(p) if w == t]))])
    hits = found.filter(F.col("term").isin(*terms)).withColumn("x", F.explode(places[F.col("term")]))
    hits = hits.groupBy(*ROW, "col", "x.i", "x.n", (F.col("pos") - F.col("x.k")).alias("start")).agg(F.count("*").alias("m")).filter("m = n")
    rows = hits.groupBy(*ROW).agg(*[F.count_if(F.col("i") == i).alias(f"f{i}") for i in range(len(wanted))])
    rows = stored(rows)
    counts = rows.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(wanted))])
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).crossJoin(F.broadcast(counts))  # one row each
    both = reduce(lambda x, i: x.filter(F.col(f"f{i}") > 0), range(len(wanted)), rows).join(lengths, list(ROW)).withColumn("row_key", F.struct(*ROW))
    return ranked(both, stats, len(wanted), "row_key").select("row_key.*", "score")


def ranked(rows: DataFrame, stats: DataFrame, count: int, key: str) -> DataFrame:
    """key, score of the rows (key, dl, f0 ...) with all phrases, by one row of n, avgdl, n0 ..."""
    hits = rows
    for i in range(count):
        hits = hits.filter(F.col(f"f{i}") > 0)
    hits = hits.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(count):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)))
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.select(key, score.alias("score"))


def search(texts: DataFrame, nodes: DataFrame, query: str, limit: int = 10, node_type: str | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """path, name, type, score, reasons: full-text hits and name matches, boosted, the best first.

    Full-text rows that belong to a node count for it (the best row); others stand for themselves. The type
    filter comes before the candidate cap of max(5 * limit, 50); a name match adds once, a path match adds once. With an
    index (indexed()) texts aren't read.
    """
    q = query.strip()
    low = q.lower()
    facts = nodes.select("id", "type", F.col("name").alias("node_name"), F.col("path").alias("node_path"))
    if node_type is not None:
        facts = facts.filter(F.col("type") == node_type)
    # rows keep their own key while they are ranked
    scored = stored_bm25(*index, q) if index else bm25(keyed(texts).withColumn("row_key", F.struct(*ROW)), q, "row_key").select("row_key.*", "score")
    typed = scored.join(facts.select(F.col("id").alias("doc_key"), "type"), "doc_key", "left" if node_type is None else "inner")
    cap = max(5 * limit, 50)
    hits = typed.orderBy(F.desc("score"), "doc_key", "path", "name").limit(cap)
    hits = hits.groupBy("doc_key").agg(F.max("score").alias("score"), F.max_by("path", "score").alias("path"), F.max_by("name", "score").alias("name"), F.first("type").alias("type"))
    exact, partial = F.lower("node_name") == low, F.lower("node_name").contains(low)
    named = facts.filter((exact | partial) & F.lit(bool(q))).orderBy(F.when(exact, 0).otherwise(1), "id").limit(NAME_MATCHES)
    named = named.select(F.col("id").alias("doc_key"), F.when(exact, EXACT).otherwise(PARTIAL).alias("boost"), "node_name", "node_path", F.col("type").alias("node_kind"))
    both = hits.join(named, "doc_key", "full")
    path = F.coalesce("path", "node_path")
    in_path = F.lower(path).contains(low)
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0)) + F.when(in_path, PATH).otherwise(0.0)
    reasons = F.filter(F.array(F.when(F.col("score").isNotNull(), "full-text match"), F.when(F.col("boost") == EXACT, "exact name match").when(F.col("boost") == PARTIAL, "name contains query"), F.when(in_path, "path match")), lambda r: r.isNotNull())
    out = both.select("doc_key", path.alias("path"), F.coalesce("name", "node_name").alias("name"), F.coalesce("type", "node_kind").alias("type"), score.alias("total"), F.array_join(reasons, ", ").alias("reasons"))
    return out.orderBy(F.desc("total"), "doc_key").limit(limit).select("path", "name", "type", F.round("total", 6).alias("score"), "reasons")


def search_types(texts: DataFrame, nodes: DataFrame, query: str, types: list[str], limit: int = 10, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The search for each type, put together, the best of all."""
    parts = [search(texts, nodes, query, limit, t, index) for t in types]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "path", "name", "type").limit(limit)


def snippet(content: str, phrase: list[str], width: int = 12) -> str:
    """The earliest window of ``width`` tokens with most hits, hits in brackets, cuts marked by an ellipsis."""
    import re

    found = [(m.start(), m.end(), "".join(_PLAIN.get(c, c) for c in m.group().lower()) in phrase) for m in re.finditer(r"[^\W_]+", content)]
    if not found:
        return ""
    sums = [sum(h for _, _, h in found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    at = sums.index(max(sums))
    window, out, last = found[at : at + width], [], None
    for start, end, hit in window:
        if last is not None:
            out.append(content[last:start])
        out.append(f"[{content[start:end]}]" if hit else content[start:end])
        last = end
    return ("…" if at else "") + "".join(out) + ("…" if at + width < len(found) else "")
