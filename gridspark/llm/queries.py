"""The registered queries of the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm import align, decontam, dedup, jaccard, langid, order, packing, pii, search, shards, toxicity, urls
from gridspark.llm.bpe import Tokenizer
from gridspark.llm.common import crc_mod, ready
from gridspark.runtime import new_dir

# Fixed values of the contracts.
URL_RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"),
             urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``plan(spark, table)`` under its name, with its SQL twin if there is one."""

    def register(plan):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ready(spark)
            return plan(spark, lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))

        QUERIES[plan.__name__] = run
        if sql is not None:
            ORACLES[plan.__name__] = sql
        return plan

    return register


@query()
def op1_language(spark, table):
    docs = table("documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    network = langid.fit(docs.where(~held_out))
    return langid.with_language(docs.select("doc_id", "text", held_out.alias("held_out")), network).select("doc_id", "held_out", "lang_pred", "score")


@query("""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
         r AS (SELECT doc_id, sha256(norm) AS text_sha256, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                      count(*) OVER (PARTITION BY norm) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""")
def op2_exact_dedup(spark, table):
    groups = dedup.exact_groups(table("documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op3_shards(spark, table):
    text = F.coalesce("text", F.lit(""))
    rows = table("documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                     F.crc32(text).alias("text_crc32"))
    return (shards.shuffle_into_shards(rows, 8)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def tokenizer() -> Tokenizer:
    return Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op4_training_order(spark, table):
    """Every record of the written shards: where it is and what it holds."""
    written = order.materialise_order(table("documents").select("doc_id", "text"), tokenizer(), new_dir(spark, "llm-order"))
    return (written.records(spark)
            .select("slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")))


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    rows = docs.select("doc_id", tokenizer().encode_and_decode("text").alias("both")).select("doc_id", "both.*")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op5_byte_bpe(spark, table):
    return token_digests(table("documents"))


# The same patterns without the hints that only help Spark's engine.
SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": pii.PATTERNS["iban"],
}
SQL_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INTEGER), 999) > 255)) = 0",
    "card": """len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, len(d)), lambda i:
               CASE WHEN i % 2 = 0 THEN d[len(d) - i]::INT WHEN d[len(d) - i]::INT > 4 THEN d[len(d) - i]::INT * 2 - 9
                    ELSE d[len(d) - i]::INT * 2 END)) % 10 = 0""",
    "phone": "len(d) BETWEEN 9 AND 15",
    "iban": """list_reduce(list_prepend(0, list_transform(string_split(replace(v, ' ', '')[5:] || v[1:4], ''), lambda c: (ascii(c) - 48)::BIGINT)),
               lambda r, c: CASE WHEN c < 10 THEN (r * 10 + c) % 97 ELSE (r * 100 + c - 7) % 97 END) = 1""",
}


def _pii_sql() -> str:
    parts = []
    for k, (kind, pattern) in enumerate(SQL_PATTERNS.items()):
        parts.append(f"""
    {kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS p FROM d),
    {kind}_s AS (SELECT doc_id, f[i] AS v, list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: len(x))), 0) AS s,
                        regexp_replace(f[i], '[^0-9]', '', 'g') AS d
                 FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM {kind}_m WHERE len(f) > 0)),
    {kind} AS (SELECT doc_id, {k} AS k, '{kind}' AS kind, s::BIGINT AS s, (s + len(v))::BIGINT AS e FROM {kind}_s WHERE {SQL_VALID[kind]})""")
    union = " UNION ALL ".join(f"SELECT * FROM {kind}" for kind in SQL_PATTERNS)
    item = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {",".join(parts)},
    a AS ({union}),
    g AS (SELECT doc_id, {counts}, string_agg({item}, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg({item}, ',' ORDER BY k, s) AS spans
          FROM a GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


@query(_pii_sql())
def op8_personal_data(spark, table):
    found = pii.find_spans(table("documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.listed(F.col("spans"), pii.BASE), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def _url_sql() -> str:
    rule = "NULL"
    for r in sorted(URL_RULES, key=lambda r: len(r.name)):
        rule = f"CASE WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}' ELSE {rule} END"
    verdict = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in URL_RULES)
    lower = f"'{urls.UPPER}', '{urls.LOWER}'"
    values, rounds = "seed", []
    for k in range(urls.ROUNDS):
        rounds.append(f"""v{k} AS (SELECT host, kind, sum(value) AS value FROM (
            SELECT "to" AS host, s.kind, share * value * {urls.DAMPING} AS value FROM steps s JOIN {values} v ON s.host = v.host AND s.kind = v.kind
            UNION ALL SELECT * FROM seed) GROUP BY ALL)""")
        values = f"v{k}"
    link = urls.LINK.replace("'", "''")
    return f"""WITH r AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), {lower}) AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM r),
    j AS (SELECT *, {rule} AS rule FROM h),
    v AS (SELECT *, CASE rule {verdict} END AS decided FROM j),
    seeds AS (SELECT host, avg(CASE WHEN decided = 'allow' THEN 1.0 ELSE 0 END) AS trust, avg(CASE WHEN decided = 'block' THEN 1.0 ELSE 0 END) AS distrust
              FROM v WHERE host <> '' GROUP BY host),
    seed AS (SELECT host, 'trust' AS kind, trust AS value FROM seeds WHERE trust > 0 UNION ALL SELECT host, 'distrust', distrust FROM seeds WHERE distrust > 0),
    e AS (SELECT source, target, count(*) AS n FROM (
            SELECT host AS source, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {lower}) AS target FROM h WHERE host <> '')
          WHERE target <> source GROUP BY ALL),
    steps AS (SELECT 'trust' AS kind, source AS host, target AS "to", n / sum(n) OVER (PARTITION BY source) AS share FROM e
              UNION ALL SELECT 'distrust', target, source, n / sum(n) OVER (PARTITION BY source) FROM e),
    {", ".join(rounds)},
    m AS (SELECT host, coalesce(sum(value) FILTER (kind = 'distrust'), 0) - coalesce(sum(value) FILTER (kind = 'trust'), 0) AS margin FROM {values} GROUP BY host)
    SELECT page_id, v.host, path, rule, coalesce(decided, CASE WHEN margin >= {urls.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
    FROM v LEFT JOIN m ON v.host = m.host"""


@query(_url_sql())
def op9_url_filter(spark, table):
    return (urls.judge(table("pages").select("page_id", "url", "html"), URL_RULES)
            .select("page_id", "host", "path", "rule", "verdict"))


@query()
def op10_toxicity(spark, table):
    docs = table("documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    index = toxicity.fit(docs.where(~held_out), table("labels").where(~held_out))
    return (toxicity.with_toxicity(docs.withColumn("held_out", held_out), index)
            .select("doc_id", "held_out", "score", "predicted"))


@query()
def op6_decontamination(spark, table):
    return decontam.contaminated(table("documents").select("doc_id", "text"), table("benchmark"))


@query()
def op7_jaccard_join(spark, table):
    return jaccard.near_duplicates(table("documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query("""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
    items AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
    asked AS (SELECT item, item_id, term, count(*) AS q FROM items GROUP BY ALL),
    corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
    posting AS (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs),
    tf AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM posting WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, n_docs),
    score AS (SELECT item, item_id, row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
              FROM asked JOIN tf USING (term) JOIN weight USING (term), corpus GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM score WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10""")
def op11_search(spark, table):
    """Each item's ten best documents."""
    return search.ranked(table("documents").select("doc_id", "text"), table("benchmark").select("item_id", "text"))


@query()
def op12_packing(spark, table):
    """The place of every piece of every document."""
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(table("documents").select("doc_id", "text"), tokenizer)


@query()
def op13_alignment(spark, table):
    """How the tokens of every document under two tokenizers are linked."""
    found = align.alignment(table("documents").select("doc_id", "text"), align.ByteTokens(public_tokenizers.path("byte_bpe_50k.json")),
                            align.PieceTokens(public_tokenizers.path("piece_bpe_32k.model")))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
