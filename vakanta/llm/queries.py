"""The corpus operators as registered queries over whole tables, and expected SQL where there is one."""

from __future__ import annotations

import html.entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanta.llm import bpe, centroids, collocations, fingerprints, language, packing, pii, secrets, sharding, simhash, token_files, topk, warc
from vakanta.llm.common import checkpointed


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_top_k_search(spark, sf):
    vectors = checkpointed(topk.integer_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")))
    return topk.top_k(vectors.filter(F.pmod("key", F.lit(50)) == 0), vectors, k=5).drop("query_row")


def op2_sharding(spark, sf):
    return sharding.place(_documents(spark, sf), [1.0] * 24).withColumn("law", F.lit("key"))


def op3_secret_scan(spark, sf):
    found = secrets.report(secrets.scan(_documents(spark, sf)))
    return found.select(
        F.col("path").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op4_bpe(spark, sf):
    found = bpe.encode_documents(_documents(spark, sf), tokenizer_file("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_token_files(spark, sf):
    found = token_files.token_files(_documents(spark, sf), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_simhash(spark, sf):
    found = simhash.near_duplicates(_documents(spark, sf))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_packing(spark, sf):
    return packing.pack_documents(_documents(spark, sf))


def op8_warc(spark, sf):
    return warc.derive(warc.responses(spark.read.parquet(f"{sf}/pages.parquet"))).withColumnRenamed("key", "page_id")


def op9_fingerprints(spark, sf):
    return fingerprints.compare_versions(_documents(spark, sf))


def op10_language_id(spark, sf):
    return language.predict_held_out(_documents(spark, sf), tokenizer_file("piece_bpe_32k.model"))


def op11_phrase_collocations(spark, sf):
    return collocations.collocations(_documents(spark, sf))


def op12_centroid_clusters(spark, sf):
    found = centroids.cluster_report(centroids.whole_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), width=64), k=40, rounds=5)
    return found.drop("compared").withColumnRenamed("key", "vec_id")


def op13_personal_data(spark, sf):
    docs = _documents(spark, sf)
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k_search, op2_sharding, op3_secret_scan, op4_bpe, op5_token_files, op6_simhash, op7_packing, op8_warc,
        op9_fingerprints, op10_language_id, op11_phrase_collocations, op12_centroid_clusters, op13_personal_data,
    )
}


def _sql_uuid(kind: str, *parts: str) -> str:
    h = f"md5(concat_ws('|', '{kind}', {', '.join(parts)}))"
    cuts = ", ".join(f"substr({h}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {cuts}) || '>'"


# what the given pages' entities stand for, in plain SQL: names by a map, numbers by chr
SQL_PLAIN = (
    ("<(script|style)([ \t\r\n\f/][^>]*)?>.*?(</(script|style)[ \t\r\n\f/]*>|$)", " ", "gis"),
    ("<!--.*?(-->|$)", " ", "gs"),
    (
        "</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|aside|title|head|body|html|pre|blockquote|form|main|hr|dd|dt)"
        "([ \t\r\n\f/][^>]*)?>",
        chr(10),
        "gi",
    ),
    ("<[a-zA-Z/!?][^>]*>", "", "g"),
)


def _sql_entities(column: str) -> str:
    """Pieces between ampersands: a name or number and its semicolon in front of each becomes its characters."""
    names = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    quoted = [", ".join("'" + x.replace("'", "''") + "'" for x in part) for part in (names.keys(), names.values())]
    known = f"map([{quoted[0]}], [{quoted[1]}])"
    piece = (
        "case when regexp_matches(p, '^#[0-9]+;') then chr(cast(regexp_extract(p, '^#([0-9]+);', 1) as integer)) || regexp_replace(p, '^#[0-9]+;', '') "
        f"when {known}[regexp_extract(p, '^([a-zA-Z0-9]+);', 1)] is not null "
        f"then {known}[regexp_extract(p, '^([a-zA-Z0-9]+);', 1)] || regexp_replace(p, '^[a-zA-Z0-9]+;', '') else '&' || p end"
    )
    split = f"string_split({column}, '&')"
    return f"{split}[1] || array_to_string(list_transform({split}[2:], lambda p: {piece}), '')"


def _sql_text(column: str) -> str:
    for pattern, new, flags in SQL_PLAIN:
        column = f"regexp_replace({column}, '{pattern}', '{new}', '{flags}')"
    column = f"regexp_replace({_sql_entities(column)}, '[ \t\r\f\u00a0]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({column}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


WARC_SQL = f"""
with responses as (
  select page_id, url as target_uri, coalesce(html, '') as payload, 'sha256:' || sha256(coalesce(html, '')) as source_digest from pages
), named as (
  select *, {_sql_uuid("response", "coalesce(cast(page_id as varchar), '')", "coalesce(target_uri, '')", "source_digest")} as refers_to,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: '
      || strlen(payload) || chr(13) || chr(10) || chr(13) || chr(10) as source_header,
    {_sql_text("payload")} as txt,
    replace({_sql_text("regexp_extract(payload, '(?is)<title(?:[ \\t\\r\\n/][^>]*)?>(.*?)</title', 1)")}, chr(10), ' ') as title,
    len(regexp_extract_all(payload, '(?i)<a[ \\t\\r\\n][^>]*href')) as links
  from responses
), both_records as (
  select page_id, 'conversion' as type, {_sql_uuid("conversion", "refers_to")} as record_id, refers_to, target_uri,
    'text/plain; charset=utf-8' as content_type, source_header, source_digest, txt as block from named
  union all
  select page_id, 'metadata', {_sql_uuid("metadata", "refers_to")}, refers_to, target_uri, 'application/warc-fields', source_header, source_digest,
    'title: ' || title || chr(13) || chr(10) || 'outlinks: ' || links || chr(13) || chr(10)
      || 'conversion: ' || {_sql_uuid("conversion", "refers_to")} || chr(13) || chr(10)
      || 'conversion-digest: sha256:' || sha256(txt) || chr(13) || chr(10)
      || 'payload-length: ' || strlen(payload) || chr(13) || chr(10)
  from named
)
select page_id, type, record_id, refers_to, target_uri, '{warc.FETCHED}' as date, content_type, source_header, source_digest,
  'sha256:' || sha256(block) as block_digest, strlen(block) as content_length, block from both_records
"""

TOP_K_SQL = """
with vectors as (
  select row_number() over () as row_no, vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scores as (
  select q.row_no, q.vec_id as query_id, c.vec_id,
    coalesce(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v) if p[1] is not null and p[2] is not null]), 0)::bigint as score
  from vectors q join vectors c on q.row_no <> c.row_no where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by row_no order by score desc, vec_id) as integer) as rank, vec_id, score
from scores qualify rank <= 5
"""



def _sql_matches(place: int, rule: secrets.Rule) -> str:
    """Matches of one rule per document: lengths of the texts between and of the matches, by splitting at them."""
    pattern = rule.pattern.replace("'", "''")
    judged = f"regexp_extract_all(t, '{pattern}', {rule.group})"
    return (
        f"select doc_id, row_no, {place} as place, '{rule.kind}' as kind, string_split_regex(t, '{pattern}') as gaps, "
        f"regexp_extract_all(t, '{pattern}') as found, [len(v) >= {rule.least} for v in {judged}] as fits from texts"
    )


SECRET_SQL = f"""
with texts as (select doc_id, row_number() over () as row_no, coalesce(text, '') as t from documents),
matches as ({" union all ".join(_sql_matches(i, r) for i, r in enumerate(secrets.RULES))}),
each_match as (select *, unnest(range(1, len(found) + 1)) as i from matches),
measured as (select row_no, place, kind, i, len(found[i]) as size, fits[i] as fit,
  sum(len(gaps[i]) + len(found[i])) over (partition by row_no, place order by i) as stop from each_match),
spans as (select row_no, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
  count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || (stop - size)::bigint || ':' || stop::bigint, ',' order by stop - size, place) as spans
  from measured where fit group by row_no)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join spans using (row_no)
"""

COLLOCATION_SQL = r"""
with folded as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), pieces as (
  select lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\f\r]')) as piece from folded
), split as (
  select lang, regexp_extract_all(piece, '[^ \t]+') as ws from pieces
), places as (
  select lang, ws, unnest(range(1, len(ws) + 1)) as i from split
), counts as (
  select lang, size, array_to_string(ws[i : i + size - 1], ' ') as phrase, count(*) as f
  from places cross join (select unnest([1, 2, 3]) as size) sizes where i + size - 1 <= len(ws) group by all
), totals as (
  select lang, cast(sum(f) as bigint) as n from counts where size = 1 group by lang
), frequent as (
  select lang, size, phrase, string_split(phrase, ' ') as ws, f as a from counts where size > 1 and f >= 10
), longer as (
  select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase, a from frequent where size = 3
), longest as (
  select lang, phrase, max(a) as most from longer group by all
), kept as (
  select c.* from frequent c left join longest using (lang, phrase) where most is null or 100 * most < 50 * a
), cuts as (
  select lang, size, phrase, ws, a, unnest(range(1, size)) as k from kept
), parts as (
  select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:size], ' ') as tail from cuts
), scored as (
  select p.lang, p.phrase, p.a, p.k, x.f as l, y.f as r, cast((1000000::hugeint * p.a * p.a) // (x.f::hugeint * y.f) as bigint) as score
  from parts p join counts x on x.lang = p.lang and x.phrase = p.head join counts y on y.lang = p.lang and y.phrase = p.tail
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as integer) as rank, phrase, a, l, r, n, score
from lowest join totals using (lang) qualify rank <= 2000
"""


def _sql_rounds(rounds: int) -> str:
    """Each round: the nearest centroid of every vector, then floored means; at the end one more assignment."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""near{i} as materialized (
  select id, min(struct_pack(d := d, c := c)) as best from (
    select v.id, c.c, cast(v.square + c.square - 2 * list_inner_product(v.wide, c.wide) as bigint) as d from kept v cross join centres{i} c
  ) group by id
)""")
        if i < rounds:
            out.append(f"""centres{i + 1} as materialized (
  select c, v, v::double[] as wide, list_inner_product(v::double[], v::double[]) as square from (
    select o.c, coalesce(m.v, o.v) as v from centres{i} o left join (
      select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by place) as v from (
        select n.best.c as c, place, sum(x) as s, count(*) as n from near{i} n join parts p using (id) group by all
      ) group by c
    ) m on o.c = m.c
  )
)""")
    return ",\n".join(out)


CLUSTER_SQL = f"""
with whole as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v, row_number() over () as id
  from embeddings where len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), kept as materialized (
  select *, v::double[] as wide, list_inner_product(v::double[], v::double[]) as square from whole
), parts as (
  select id, unnest(v) as x, generate_subscripts(v, 1) as place from kept
), centres0 as materialized (
  select cast(row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as integer) as c, v, wide, square
  from kept qualify c < 40
), {_sql_rounds(5)}
select vec_id, cast(best.c as integer) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
  cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(e.v, ',')) as centroid_sha256
from near5 join kept using (id) join centres5 e on e.c = best.c
"""

# The others have no SQL here: they need XXH64, tokenizers, a fitted model or greedy packing.
ORACLE = {"op1_top_k_search": TOP_K_SQL, "op3_secret_scan": SECRET_SQL, "op8_warc": WARC_SQL, "op11_phrase_collocations": COLLOCATION_SQL, "op12_centroid_clusters": CLUSTER_SQL}
