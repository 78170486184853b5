"""The registered queries of the operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import bpe, decontaminate, exact_dedup, lm, minhash, prefix_trie, secrets, sharding, spelling, substring_dedup, suffix_dedup, toxicity, url_filter
from harborline.llm.tables import documents, text_of


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spec = bpe.load(spark, public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, sf_dir).select("doc_id", text_of().alias("text"))
    rows = bpe.encode_decode(docs, spec)
    return rows.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(exact_dedup.digests(documents(spark, sf_dir)))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.col("digest").alias("text_sha256"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "class_id", "class_size", "kept"
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.with_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rules_table(spark))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.labelled_rows(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold() == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"), "threshold", "rejected",
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = secrets.scan_batches(documents(spark, sf_dir), secrets.empty_ledger(spark))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,order:bigint,kind:string,end:bigint>>"))
    listed = lambda xs: F.array_join(
        F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda kind: lambda s: s["kind"] == kind
    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *(
            F.size(F.filter(spans, of_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE
        ),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), "batch", "reused",
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_passages(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(documents(spark, sf_dir)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_lm_score": op2_lm_score,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_minhash": op5_minhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a text of code points below 256 that are ASCII or letters."""
    octets = (
        f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 "
        "THEN [unicode(ch)::UBIGINT] ELSE [195::UBIGINT, (unicode(ch) - 64)::UBIGINT] END))"
    )
    shifted = "list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))"
    step = f"lambda c, b: xor(c >> 8, {shifted})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), {step}), 4294967295::UBIGINT)"


#: One byte for each letter that a spelling may have beside a to z, as ``levenshtein`` counts bytes in SQL.
LETTERS = "".join(map(chr, range(0xC0, 0x100)))
OCTETS = "".join(map(chr, range(33, 97))).replace("'", "''")

ORACLES: dict[str, str] = {
    "op4_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256({LOWER}) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY {LOWER})
    """,
    "op8_url_filter": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM rest
        ), hosts AS (
            SELECT page_id, path,
                   translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
            FROM parts
        ), rules(verdict, host, path) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                   ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), met AS (
            SELECT h.page_id, h.host, h.path, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
            FROM hosts h LEFT JOIN rules r
              ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM met WHERE place = 1
    """,
    "op11_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word,
                   generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i
            FROM documents
        ), windows AS (
            SELECT doc_id, i, word, string_agg(word, ' ') OVER here AS text, count(*) OVER here AS n
            FROM words WINDOW here AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
        ), late AS (
            SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY text, n ORDER BY doc_id, i) > 1 AS late FROM windows
        ), judged AS (
            SELECT doc_id, i, word, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
            FROM late
        ), kept AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
            FROM judged GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
    "op12_spelling": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
            ) GROUP BY ALL
        ), hashed AS (
            SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs
        ), spared AS (
            SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                           ELSE run END AS word
            FROM hashed
        ), words AS (
            SELECT word, translate(word, '{LETTERS}', '{OCTETS}') AS octets, sum(n)::BIGINT AS n FROM spared WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n
            FROM words a JOIN words b ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word
             AND (substr(a.word, 1, length(a.word) // 2) = substr(b.word, 1, length(a.word) // 2)
                  OR right(a.word, length(a.word) - length(a.word) // 2) = right(b.word, length(a.word) - length(a.word) // 2))
            WHERE levenshtein(a.octets, b.octets) = 1
        ), best AS (
            SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n
            FROM near GROUP BY word
        ), formed AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form,
                   CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
            FROM words w LEFT JOIN best b USING (word)
        ), steps(word, place, form) AS (
            SELECT word, word, form FROM formed
            UNION ALL SELECT s.word, f.word, f.form FROM (SELECT * FROM steps WHERE form IS NOT NULL) s JOIN formed f ON f.word = s.form
        )
        SELECT f.word, f.form, s.place AS root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON s.word = f.word AND s.form IS NULL
    """,
    "op13_prefix_trie": f"""
        WITH own AS (
            SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), heads AS (
            SELECT *, ({crc32_sql("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM own
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
            FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
        ), prefixes AS (
            SELECT conv_id, len(turns) AS length, d, turns[1:d] AS path
            FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
        ), nodes AS (
            SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = d), '') AS ends
            FROM prefixes GROUP BY d, path
        ), children AS (
            SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
        ), sized AS (
            SELECT n.*, coalesce(c.n_children, 0) AS n_children,
                   (n_convs - 1) * CASE WHEN n.d = 0 THEN 0 ELSE octet_length(encode(n.path[n.d].text)) END AS saved
            FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.path = n.path
        ), upward AS (
            SELECT n_children, saved, up, path[1:up] AS path FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM sized)
        ), sums AS (
            SELECT up, path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM upward GROUP BY ALL
        )
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
               sha256(n.ends) AS ends_sha256
        FROM sized n JOIN sums s ON s.up = n.d AND s.path = n.path LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
    """,
}
