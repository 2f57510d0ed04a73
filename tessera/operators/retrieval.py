"""Retrieval: inverted index and BM25, exact vector search, fuzzy titles, and their fusion."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import embed
from tessera.functions.text import jaro_winkler_column, search_tokens
from tessera.lineage import checkpointed, rows_of
from tessera.operators.scoring import apply_quality, rrf, with_scalars
from tessera.schema import Bm25


#: Most terms of queries, with their weights, that go to every task.
MOST_QUERY_TERMS = 200_000


@dataclass
class Index:
    """postings (term, id, ord, tf, dl), terms (term, df, idf), totals (n, avgdl) of one row."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def spread(docs: DataFrame) -> DataFrame:
    """Rows on all cores: where an input has fewer splits than there are cores, and so is small, it is dealt anew."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def term_counts(tokens: Column) -> Column:
    """(term, tf) of each different token, as an array: tokens in order, cut where one ends."""
    def counted(s: Column) -> Column:
        ends = F.array_compact(F.transform(s, lambda x, i: F.when(F.get(s, i + 1).eqNullSafe(x), F.lit(None)).otherwise(i + 1)))
        return embed.once(ends, lambda e: F.transform(e, lambda end, k: F.struct(F.get(s, end - 1).alias("term"), (end - F.when(k == 0, 0).otherwise(F.get(e, k - 1))).cast("long").alias("tf"))))

    return embed.once(F.sort_array(tokens), counted)


def build_index(docs: DataFrame, wanted: DataFrame | None = None, tokenizer: Callable[[Column], Column] = search_tokens) -> Index:
    """The inverted index of docs (id, ord, text): a document's terms are counted in its own row, so postings need no shuffle.

    With `wanted` (term), only these terms are indexed. The totals are those of all
    tokens in any case.
    """
    tokens = spread(docs.select("id", "ord", "text")).select("id", "ord", tokenizer(F.col("text")).alias("tokens"))
    totals = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    counts = tokens.select("id", "ord", F.size("tokens").alias("dl"), term_counts(F.col("tokens")).alias("counts"))
    # not explode: Spark would look for texts without tokens first, and for that cut and count every text again
    postings = counts.select("id", "ord", "dl", F.explode_outer("counts").alias("p")).filter("p IS NOT NULL").select("p.term", "id", "ord", "dl", "p.tf")
    if wanted is not None:
        postings, totals = postings.join(wanted.select("term").distinct(), "term", "left_semi"), checkpointed(totals)
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return Index(postings, df.crossJoin(F.broadcast(totals)).select("term", "df", idf.alias("idf")), totals)


def query_terms(queries: DataFrame, tokenizer: Callable[[Column], Column] = search_tokens) -> DataFrame:
    """(qid, term, qtf) of queries (qid, text)."""
    return queries.select("qid", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def length_norm(dl: Column, avgdl: Column, p: Bm25 = Bm25()) -> Column:
    return F.when(avgdl > 0, 1 - p.b + p.b * dl / avgdl).otherwise(1.0)


def term_weight(tf: Column, norm: Column, p: Bm25 = Bm25()) -> Column:
    return tf * (p.k1 + 1) / (tf + p.k1 * norm)


def bm25(index: Index, queries: DataFrame, p: Bm25 = Bm25(), allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, ord, score) of queries (qid, text), rounded for stable ties; `allowed` ids narrow postings alone, statistics stay whole.

    One plan for one query or a log of them. The postings of a document come together
    first; then weighted query terms, if they are few enough to go to all tasks, meet
    them where they are, and scores, as many as queries times documents, are summed
    there. More query terms than that meet postings on the term.
    """
    q = checkpointed(query_terms(queries).join(index.terms, "term"))
    postings = index.postings if allowed is None else index.postings.join(allowed.select("id"), "id", "left_semi")
    if rows_of(q) <= MOST_QUERY_TERMS:
        tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hits = postings.repartition(tasks, "id").join(F.broadcast(q), "term")
    else:
        hits = q.join(postings, "term")
    part = F.col("qtf") * F.col("idf") * term_weight(F.col("tf"), length_norm(F.col("dl"), F.col("avgdl"), p), p)
    hits = hits.crossJoin(F.broadcast(index.totals))
    return hits.groupBy("qid", "id", "ord").agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")


def normalised(v: Column) -> Column:
    """The vector at length one, as doubles; a zero vector as it is."""
    x = v.cast("array<double>")
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    return F.when(n > 0, F.transform(x, lambda e: e / n)).otherwise(x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)


def vector_top(index: DataFrame, query: list[float], k: int = 300, least: float = 0.3, allowed: DataFrame | None = None) -> DataFrame:
    """(id, ord, score): the k rows of index (id, ord, vec) closest to the query by cosine.

    Allowed ids are chosen before the k; a vector of another length is an error.
    """
    rows = index if allowed is None else index.join(allowed.select("id"), "id", "left_semi")
    checked = F.when(F.size("vec") == len(query), F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("vector of another length: "), F.col("id"))).cast("array<double>"))
    q = normalised(F.array(*(F.lit(float(x)) for x in query)))
    scored = rows.select("id", "ord", F.round(dot(normalised(checked), q), 9).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.col("score").desc(), F.col("ord").asc()).limit(k)


def fuzzy_titles(items: DataFrame, query: str, least: float = 0.55, top: int = 50) -> DataFrame:
    """(id, ord, score): titles like the query by Jaro-Winkler, the best of each item's names.

    Names without a common character are passed over before the function is called; a
    query of one or two characters needs all of them.
    """
    q = query.strip().lower()
    chars = sorted(set(q.replace(" ", "")))
    if not chars:
        return items.select("id", "ord", F.lit(0.0).alias("score")).limit(0)
    names = items.select("id", "ord", F.explode(F.array_compact(F.array("name", "name_zh"))).alias("title")).withColumn("title", F.lower(F.trim("title")))
    hits = [F.instr("title", c) > 0 for c in chars]
    test = hits[0]
    for h in hits[1:]:
        test = (test & h) if len(q) <= 2 else (test | h)
    scored = names.filter(test).withColumn("score", F.round(jaro_winkler_column(F.col("title"), F.lit(q)), 9))
    return scored.groupBy("id", "ord").agg(F.max("score").alias("score")).filter(F.col("score") >= least).orderBy(F.col("score").desc(), F.col("ord").asc()).limit(top)


def ranked(scores: DataFrame) -> DataFrame:
    """(id, rank): places of a bounded list by score, ties by ord."""
    from pyspark.sql import Window

    return scores.select("id", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("ord").asc())).alias("rank"))


@dataclass(frozen=True)
class Profile:
    key: str
    label: str
    query_terms: tuple[str, ...]
    candidate_terms: tuple[str, ...]


@dataclass
class Intent:
    raw: str
    recall: str
    positive: list[str]
    negative: list[str]
    phrases: list[str]
    profiles: list[Profile] = field(default_factory=list)

    @property
    def pure_negative(self) -> bool:
        return bool(self.negative) and not self.positive


# Words that exclude what follows them.
NEGATIONS = [
    r"(?:不要|不需要|无需|不用|不想要|不想|避免|排除|去掉|不含|不带|拒绝|别)\s*([a-z0-9][a-z0-9_-]*|[一-鿿]{1,8})",
    r"(?:without|exclude|excluding|avoid|no)\s+([a-z0-9][a-z0-9_-]*(?:\s+[a-z0-9][a-z0-9_-]*)?)",
    r"(?:^|\s)-([^\s,，。！？!?；;]+)",
]


def squeezed(text: str) -> str:
    return " ".join(text.lower().split())


def once(values) -> list[str]:
    return list(dict.fromkeys(v for v in map(squeezed, values) if v))


def word_in(text: str, word: str) -> bool:
    """Whether a text has the words; ASCII ones only between other characters than letters and digits."""
    if re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", word):
        return bool(re.search(rf"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])".replace(r"\ ", r"\s+"), text))
    return word in text or word.replace(" ", "") in text.replace(" ", "")


def parse_intent(query: str, profiles: list[Profile] = ()) -> Intent:
    """What a query excludes, asks for, quotes, and which known intents it names."""
    text, negative = squeezed(query), []
    for pattern in NEGATIONS:
        negative += re.findall(pattern, text, re.ASCII)
        text = re.sub(pattern, " ", text, flags=re.ASCII)
    whole, text = squeezed(query), squeezed(text)
    active = [p for p in profiles if any(word_in(whole, squeezed(t)) for t in p.query_terms)]
    named = [t for p in active for t in p.query_terms if word_in(whole, squeezed(t))]
    recall = squeezed(re.sub("[\"“”',，、;；]+", " ", text))
    return Intent(query, recall, once(re.findall(r"[a-z0-9]+|[一-鿿]{2,}", text)), once(negative), once(re.findall('["“]([^"”]{2,})["”]', whole) + named), active)


def term_hit(text: Column, term: str, variants: list[str] = ()) -> Column:
    """Whether a lower-case text has a term or one of its variants; ASCII ones of up to three characters only as words."""
    out = F.lit(False)
    for v in once([term, *variants]):
        short = re.fullmatch(r"[a-z0-9]{1,3}", v)
        out = out | (text.rlike(f"(?<![a-z0-9]){v}(?![a-z0-9])") if short else F.instr(text, v) > 0)
    return out


def rerank(pool: DataFrame, intent: Intent, text: Column) -> DataFrame:
    """pool (id, score, position) with `rerank` and the counts of matches; the multiplier stays between 0.3 and 1.4."""
    t = F.lower(text)
    count = lambda terms: sum((F.when(term_hit(t, x), 1).otherwise(0) for x in terms), F.lit(0))
    intents = sum((F.when(sum((F.when(term_hit(t, c), 1).otherwise(0) for c in p.candidate_terms), F.lit(0)) > 0, 1).otherwise(0) for p in intent.profiles), F.lit(0))
    out = pool.withColumns({"phrase_hits": count(intent.phrases), "intent_hits": intents, "negative_hits": count(intent.negative), "term_hits": count(intent.positive)})
    factor = 1 + 0.12 * F.col("phrase_hits") + 0.08 * F.col("intent_hits") - 0.30 * F.col("negative_hits")
    return out.withColumn("rerank", F.round(F.col("score") * F.greatest(F.lit(0.3), F.least(F.lit(1.4), factor)), 12))


def expand(query: str, synonyms: dict[str, list[str]]) -> str:
    """The query with the synonyms of the keys that it holds, in the table's order; ASCII keys only as words."""
    q = query.lower()
    held = [k for k in synonyms if (re.search(rf"\b{re.escape(k)}\b", q, re.ASCII) if k.isascii() else k in q)]
    return " ".join(dict.fromkeys([query, *(s for k in held for s in synonyms[k])]))


def local_search(items: DataFrame, query: str, now_ms: int, vectors: DataFrame | None = None, query_vector: list[float] | None = None, profiles: list[Profile] = (), synonyms: dict | None = None, categories: list[str] | None = None, pool: int = 300) -> DataFrame:
    """(position, id, score, rerank, signals): keyword, vector and title paths, fused, weighted by quality and reordered by intent.

    The three paths are branches of one plan, each cut to its own top before the
    fusion. items has id, name, name_zh, description, desc_zh, downloads, updated,
    category, ord. Without vectors two paths are fused.
    """
    from pyspark.sql import Window

    intent = parse_intent(query, list(profiles))
    text = F.concat_ws(" ", "name", "name_zh", "description", "desc_zh")
    scope = items.filter(F.col("category").isin(categories)) if categories else None
    if intent.pure_negative:
        base = (scope if scope is not None else items).withColumn("t", F.lower(text))
        for n in intent.negative:
            base = base.filter(~term_hit(F.col("t"), n))
        fused = base.select("id", F.lit(1.0).alias("score"), F.lit(0).alias("first_path"), F.col("ord").alias("first_rank"))
        paths = {}
    else:
        q = expand(intent.recall, synonyms) if synonyms else intent.recall
        one = items.sparkSession.createDataFrame([(0, q)], "qid int, text string")
        index = build_index(items.select("id", "ord", text.alias("text")), query_terms(one))
        top = bm25(index, one, allowed=scope).orderBy(F.col("score").desc(), F.col("ord").asc()).limit(Bm25().top)
        paths = {"keyword": ranked(top), "title": ranked(fuzzy_titles(scope if scope is not None else items, intent.recall))}
        weighted = [(paths["keyword"], 1.0), (paths["title"], 0.5)]
        if vectors is not None:
            paths["vector"] = ranked(vector_top(vectors, query_vector, allowed=scope))
            weighted = [(paths["vector"], 1.0), *weighted]
        fused = rrf(weighted)
    good = apply_quality(fused, items, now_ms).withColumn("score", F.round("score", 12))
    order = [F.col("score").desc(), F.col("first_path").asc(), F.col("first_rank").asc(), F.col("id").asc()]
    best = good.orderBy(*order).limit(pool).withColumn("at", F.row_number().over(Window.orderBy(*order)))
    reordered = rerank(best.join(items.select("id", text.alias("text")), "id"), intent, F.col("text"))
    for name, path in paths.items():
        reordered = reordered.join(path.select("id", F.lit(name).alias(f"in_{name}")), "id", "left")
    signals = F.array_compact(F.array(*(F.col(f"in_{n}") for n in ("vector", "keyword", "title") if n in paths))) if paths else F.array().cast("array<string>")
    place = F.row_number().over(Window.orderBy(F.col("rerank").desc(), F.col("at").asc()))
    return reordered.select(place.cast("long").alias("position"), "id", "score", "rerank", signals.alias("signals"))


def quantised(v: Column) -> Column:
    """One byte a number: codes with the scale and the zero that give the vector back."""
    x = v.cast("array<double>")
    low, high = F.array_min(x), F.array_max(x)
    scale = F.when(high - low > 0, (high - low) / 254).otherwise(1.0)
    zero = -low / scale - 127
    codes = F.transform(x, lambda e: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(e / scale + zero + 0.5))).cast("int"))
    return F.struct(codes.alias("codes"), scale.alias("scale"), zero.alias("zero"))


def restored(q: Column) -> Column:
    return F.transform(q.codes, lambda c: (c - q.zero) * q.scale)


def index_changes(before: DataFrame, now: DataFrame, rebuild: bool = False) -> DataFrame:
    """(id, action): embed, reuse or remove, by the content hash of each row; `rebuild` embeds all."""
    b, n = before.select("id", F.col("hash").alias("old")), now.select("id", F.col("hash").alias("new"))
    same = F.lit(not rebuild) & (F.col("old") == F.col("new"))
    return b.join(n, "id", "full").select("id", F.when(F.col("new").isNull(), "remove").when(F.col("old").isNotNull() & same, "reuse").otherwise("embed").alias("action"))


def retrieval_metrics(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """One row a bucket: recall at 5 and 10, reciprocal rank, precision at 10, from rankings (qid, id, rank) and gold (qid, id, bucket)."""
    need = gold.groupBy("qid", "bucket").agg(F.count("*").alias("wanted"))
    hits = gold.join(rankings, ["qid", "id"]).groupBy("qid").agg(*(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"h{k}") for k in (5, 10)), F.min("rank").alias("best"))
    q = need.join(hits, "qid", "left").fillna(0, ["h5", "h10"])
    return q.groupBy("bucket").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("h5") / F.col("wanted")), 6).alias("recall_5"), F.round(F.avg(F.col("h10") / F.col("wanted")), 6).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("h10") / 10), 6).alias("precision_10"))


def highlight_terms(query: Column, expanded: Column) -> Column:
    """Tokens of two characters or more of a query and of its expansion, each once: what to mark in results."""
    return F.filter(F.array_distinct(F.concat(search_tokens(query), search_tokens(F.lower(expanded)))), lambda t: F.length(t) > 1)


def path_signals(paths: dict[str, DataFrame]) -> DataFrame:
    """(id, signals): the names of the paths that found an id, in the order given."""
    rows = None
    for at, (name, path) in enumerate(paths.items()):
        r = path.select("id", F.struct(F.lit(at).alias("at"), F.lit(name).alias("name")).alias("s"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("s")).select("id", F.col("s.name").alias("signals"))


def diagnostics(pool: DataFrame, paths: dict[str, DataFrame], intent: Intent, text: Column) -> DataFrame:
    """Why each row of a bounded pool (id, score, position and what `text` needs) stands where it does.

    For each path (id, score, ord): `<path>_rank` and `<path>_score`, null where it has
    not found the row; the fused and the reranked score; and the terms, phrases,
    intents and exclusions that the row matches.
    """
    t = F.lower(text)
    matched = lambda terms: F.array_compact(F.array(*(F.when(term_hit(t, x), F.lit(x)) for x in terms))) if terms else F.array().cast("array<string>")
    named = [F.when(sum((F.when(term_hit(t, c), 1).otherwise(0) for c in p.candidate_terms), F.lit(0)) > 0, F.lit(p.label)) for p in intent.profiles]
    out = rerank(pool, intent, text).withColumns({"matched_terms": matched(intent.positive), "phrase_matches": matched(intent.phrases), "negative_matches": matched(intent.negative), "intent_matches": F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")})
    for name, path in paths.items():
        out = out.join(ranked(path).join(path.select("id", F.col("score").alias(f"{name}_score")), "id").withColumnRenamed("rank", f"{name}_rank"), "id", "left")
    facts = [c for name in paths for c in (f"{name}_rank", f"{name}_score")]
    return out.select("id", "position", *facts, F.col("score").alias("fused_score"), "rerank", "matched_terms", "phrase_matches", "intent_matches", "negative_matches")
