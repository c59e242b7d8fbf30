"""The thin queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import pii, secrets
from coppice.llm.common import cut
from coppice.llm.exact_dedup import exact_duplicates
from coppice.llm.langid import identify
from coppice.llm.mixing import mix
from coppice.llm.packing import pack
from coppice.llm.sharding import shard
from coppice.llm.simhash import near_duplicates
from coppice.llm.substrings import repeated_passages
from coppice.llm.topk import top_k
from coppice.plans.fixpoint import temporary_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_tokenizer() -> str:
    """Path of the public tokenizer's vocabulary file, installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_docs(spark, sf_dir)).drop("removed")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its findings: the base rules are scanned and stored first, then what newer rules have not seen."""
    docs = _docs(spark, sf_dir)
    ledger, paths = secrets.Ledger(spark, temporary_path(spark, "ledger")), cut(secrets.versions(docs), "versions")
    ledger.add(docs, secrets.BASE, paths)
    ledger.add(docs, secrets.RULES, paths)
    found = ledger.findings(docs, secrets.RULES, paths)
    base = tuple(r.name for r in secrets.BASE)
    counts = [secrets.count_of("spans", k).alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.digest("spans", base), 256).alias("base_sha256"),
        secrets.digest("spans", tuple(r.name for r in secrets.RULES)).alias("spans"),
    )


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_docs(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_docs(spark, sf_dir))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), word_tokenizer()).drop("row_id")


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_docs(spark, sf_dir), leaves=8)


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_docs(spark, sf_dir)).drop("source", "copies")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_docs(spark, sf_dir)).drop("xx")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_kd_sharding": op3_kd_sharding,
    "op7_pareto_mixing": op7_pareto_mixing,
    "op4_threshold_topk": op4_threshold_topk,
    "op5_personal_data": op5_personal_data,
    "op8_language_id": op8_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
}

def _secrets_sql() -> str:
    """What lies between the matches of a rule gives their places: pieces and matches in turn make up the text."""
    blank = r"\x20\x09-\x0D"
    key = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    rules = [
        # name, pattern, what a match must be; group 1 is the value of an assignment
        ("assign", rf"""(?:{key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(value) >= 8"),
        ("access", "(AKIA[A-Z0-9]+)", "length(hit) >= 16"),
        ("hex", "([0-9a-f]{32,})", "true"),
        ("pem", "(-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----)", "true"),
        ("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", "true"),
        ("github", "(gh[pousr]_[A-Za-z0-9]{36,})", "true"),
        ("bearer", r"([Bb][Ee][Aa][Rr][Ee][Rr]\x20+[A-Za-z0-9._~+/-]{20,}=*)", "true"),
        ("url", rf"([a-z][a-z0-9+.-]*://[^{blank}:/@]{{1,256}}:[^{blank}:/@]{{3,256}}@)", "true"),
    ]
    parts = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    for i, (name, pattern, passes) in enumerate(rules):
        q = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""m{i} AS (SELECT doc_id, unnest(regexp_extract_all(t, {q})) AS hit, unnest(regexp_extract_all(t, {q}, 1)) AS value,
                unnest(string_split_regex(t, {q})[1 : len(regexp_extract_all(t, {q}))]) AS piece, unnest(range(len(regexp_extract_all(t, {q})))) AS j FROM d),
            s{i} AS (SELECT doc_id, {i} AS o, '{name}' AS kind, hit, value, sum(length(piece)) OVER w + sum(length(hit)) OVER w - length(hit) AS begin_
                     FROM m{i} WINDOW w AS (PARTITION BY doc_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
            f{i} AS (SELECT doc_id, o, kind, begin_, begin_ + length(hit) AS end_ FROM s{i} WHERE {passes})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(rules)))
    told = "kind || ':' || CAST(begin_ AS BIGINT) || ':' || CAST(end_ AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (o = {i}) AS n_{rules[i][0]}" for i in range(3))
    parts.append(f"a AS ({every})")
    parts.append(
        f"""g AS (SELECT doc_id, {counts}, coalesce(string_agg({told}, ',' ORDER BY begin_, o) FILTER (o < 3), '') AS base,
             coalesce(string_agg({told}, ',' ORDER BY begin_, o, end_), '') AS spans FROM a GROUP BY doc_id)"""
    )
    names = ", ".join(f"coalesce(n_{r[0]}, 0) AS n_{r[0]}" for r in rules[:3])
    return "WITH " + ", ".join(parts) + f" SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"


ORACLES = {
    "op2_secret_scan": _secrets_sql(),
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        k AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS t FROM s),
        o AS (SELECT t, min(doc_id) AS owner FROM k GROUP BY t),
        r AS (SELECT doc_id, i FROM k JOIN o USING (t) WHERE owner < doc_id),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op4_threshold_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op7_pareto_mixing": r"""
        WITH d0 AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   (CAST('0x' || substr(md5('42:' || doc_id), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
            FROM documents),
        d AS (SELECT *, length(bin(size)) AS m FROM d0),
        s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
                      (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s0),
        s2 AS (SELECT *, row_number() OVER f AS place,
                      (total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
               FROM s1 WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
        s AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, place) FROM s2 WHERE level * w <= cap)) AS target FROM s2),
        c0 AS (SELECT d.source, m, sum(size)::BIGINT AS words, any_value(target) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.source, m),
        c1 AS (SELECT *, coalesce(sum(words) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
                      (sum(words * m) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open_words
               FROM c0 WINDOW f AS (PARTITION BY source ORDER BY m DESC)),
        c2 AS (SELECT *, CASE WHEN open_words > 0 THEN (target - 2.0::DOUBLE * capped) / open_words END AS level FROM c1),
        c3 AS (SELECT source, m, words, target, arg_min(level, -m) FILTER (level * m <= 2.0::DOUBLE) OVER (PARTITION BY source) AS level FROM c2),
        c4 AS (SELECT *, CASE WHEN target > 0 THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, coalesce(level * m, 2.0::DOUBLE))) ELSE 0.0::DOUBLE END AS e FROM c3),
        c AS (SELECT source, m, floor(e)::BIGINT AS certain, e - floor(e) AS p,
                     target - (sum(floor(e)::BIGINT * words) OVER (PARTITION BY source))::BIGINT AS need FROM c4),
        j AS (SELECT d.*, source_size, target, certain, need, p FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
              JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.m = c.m),
        q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS z FROM j),
        o AS (SELECT *, CASE WHEN z IS NOT NULL THEN sum(size) OVER (PARTITION BY source, z IS NULL ORDER BY z, doc_id ROWS UNBOUNDED PRECEDING) END AS so_far FROM q),
        g AS (SELECT source AS gs, any_value(need) - coalesce(max(so_far) FILTER (so_far <= need), 0) AS gap FROM o GROUP BY source),
        r AS (SELECT o.*, gap, coalesce(so_far <= need, false) AS sampled FROM o JOIN g ON source IS NOT DISTINCT FROM gs),
        x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN z IS NOT NULL AND NOT sampled AND size < 2 * gap THEN 0 ELSE 1 END,
                                           abs(gap - size), z, doc_id) = 1 AND z IS NOT NULL AND NOT sampled AND size < 2 * gap AS closes FROM r)
        SELECT doc_id, size, source_size, target, m AS measure, certain + p AS wanted,
               CASE WHEN size > 0 THEN (size * (certain + (sampled OR closes)::INT))::BIGINT ELSE 0 END AS taken FROM x
    """,
    "op9_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
}
