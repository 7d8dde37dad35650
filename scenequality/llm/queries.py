"""The registered queries of the subpackage, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequality.llm.common import table
from scenequality.llm.url_templates import DEPTH, LEAST_SHARE, LEAST_URLS, PRIOR_WEIGHT, REJECT_AT, SIGNIFICANT, WILDCARD, Rule

BYTE_BPE_END = 2
WORD_BPE_END = 1
URL_RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.sentence_pieces import decode, encode

    path = vocabulary("piece_bpe_32k.model")
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.token_store import read_tokens, write_tokens

    store = write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), BYTE_BPE_END)
    return read_tokens(spark, store, ids=False)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), WORD_BPE_END)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.warc import read_warc, write_warc

    found = read_warc(write_warc(table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.language import held_out, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), docs)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.tiff import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.url_templates import filter_urls

    found = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.pii import KINDS, count_of, find_personal_data, listed

    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.reversed_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenequality.llm.exact_dup import mark_copies

    return mark_copies(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentence_pieces, op2_token_store, op3_warc, op4_neighbours, op5_language, op6_tiff, op7_url_templates, op8_best_fit_packing,
        op9_personal_data, op10_near_duplicates, op11_reversed_search, op12_collocations, op13_exact_duplicates,
    )
}
# ---------------------------------------------------------------- SQL for what SQL can express

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '')
        AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def _op7() -> str:
    """The template tree level by level, with the operator's parameters."""
    fits = "\n".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN "
        f"{{'rule': '{r.text}', 'verdict': '{r.verdict}'}}" for r in sorted(URL_RULES, key=lambda r: -len(r.text))
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    steps = [f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{upper.lower()}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT *, CASE {fits} END AS found, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM u),
t0 AS (SELECT page_id, host, path, found.rule AS rule, found.verdict AS label, '' AS template,
              CASE WHEN len(parts) <= {DEPTH} THEN parts
                   ELSE list_append(parts[1:{DEPTH - 1}], array_to_string(parts[{DEPTH}:], '/')) END AS segs FROM m)"""]
    for k in range(DEPTH):
        steps.append(f"""
a{k} AS (SELECT host, template AS parent, segs[{k + 1}] AS segment, label FROM t{k} WHERE len(segs) > {k}),
c{k} AS (SELECT host, parent, segment, count(*) AS urls, count(label) AS labelled, count(*) FILTER (label = 'block') AS blocked
         FROM a{k} GROUP BY ALL HAVING count(*) >= {LEAST_URLS}),
l{k} AS (SELECT c.*, labelled > 0 AS known, CASE WHEN labelled > 0 THEN blocked / labelled END AS share FROM c{k} c
         JOIN (SELECT host, parent, count(*) AS n FROM a{k} GROUP BY ALL) n USING (host, parent) WHERE urls >= {LEAST_SHARE} * n),
g{k} AS (SELECT *, lag(blocked) OVER w AS b, lag(labelled) OVER w AS n FROM l{k}
         WINDOW w AS (PARTITION BY host, parent, known ORDER BY share, segment)),
e{k} AS (SELECT *, (blocked + b) / (labelled + n) AS q FROM g{k}),
p{k} AS (SELECT *, sum(CASE WHEN known AND share - b / n > {SIGNIFICANT} * sqrt(q * (1 - q) * (1 / labelled + 1 / n)) THEN 1 ELSE 0 END)
         OVER (PARTITION BY host, parent, known ORDER BY share, segment) AS part FROM e{k}),
b{k} AS (SELECT host, parent, list_sort(list(segment)) AS names, known, part FROM p{k} GROUP BY host, parent, known, part),
f{k} AS (SELECT p.host, p.parent, p.segment, CASE WHEN len(names) > 1 THEN '{{' || array_to_string(names, '|') || '}}' ELSE segment END AS branch
         FROM p{k} p JOIN b{k} b ON p.host = b.host AND p.parent = b.parent AND p.known = b.known AND p.part = b.part),
t{k + 1} AS (SELECT page_id, t.host, path, rule, label, segs, CASE WHEN len(segs) > {k}
         THEN template || '/' || coalesce(branch, '{WILDCARD}') ELSE template END AS template
         FROM t{k} t LEFT JOIN f{k} f ON t.host = f.host AND template = parent AND segs[{k + 1}] = segment)""")
    steps.append(f"""
o AS (SELECT coalesce(count(*) FILTER (label = 'block') / nullif(count(label), 0), 0) AS prior FROM t{DEPTH}),
z AS (SELECT host, template, CASE WHEN count(label) > 0 THEN
             (count(*) FILTER (label = 'block') + {PRIOR_WEIGHT} * any_value(prior)) / (count(label) + {PRIOR_WEIGHT}) END AS purity
      FROM t{DEPTH}, o GROUP BY host, template)""")
    return ",".join(steps) + f"""
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN purity >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict
FROM t{DEPTH} JOIN z USING (host, template)"""



_OP11 = r"""
WITH i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""

_OP12 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, len, array_to_string(words[pos:pos + len - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(words) - len + 2)) AS pos FROM w, (SELECT unnest(range(1, 6)) AS len) WHERE len(words) >= len)),
f AS MATERIALIZED (SELECT lang, len, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE len >= 2 AND a >= 100),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
i AS (SELECT DISTINCT c.lang, array_to_string(words[pos:pos + size - 1], ' ') AS phrase, a
      FROM c, (SELECT unnest(range(2, 5)) AS size), (SELECT unnest(range(1, 5)) AS pos) WHERE size < len AND pos + size - 1 <= len),
k AS (SELECT * FROM c ANTI JOIN i ON c.lang = i.lang AND c.phrase = i.phrase AND i.a >= c.a),
x AS (SELECT k.lang, k.phrase, k.a, cut, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:], ' ') AS tail
      FROM k, (SELECT unnest(range(1, 5)) AS cut) WHERE cut < len),
s AS (SELECT x.lang, x.phrase, x.a, h.a AS l, t.a AS r, n,
             CAST(CAST(1000 AS HUGEINT) * x.a * n // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score, cut
      FROM x JOIN f h ON h.lang = x.lang AND h.phrase = head JOIN f t ON t.lang = x.lang AND t.phrase = tail JOIN n ON n.lang = x.lang
      QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM s QUALIFY rank <= 2000"""

_OP13 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT *, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
             row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept FROM t WINDOW g AS (PARTITION BY text))
SELECT doc_id, keep_id, group_size, kept, sha256(text) AS text_sha256 FROM k"""

ORACLES: dict[str, str] = {
    "op3_warc": _OP3, "op7_url_templates": _op7(), "op11_reversed_search": _OP11,
    "op12_collocations": _OP12, "op13_exact_duplicates": _OP13,
}
