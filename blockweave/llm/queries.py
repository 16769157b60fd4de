"""One registered query for each operator of this subpackage, over its whole table, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm import (
    decontam,
    html_text,
    merkle,
    mixing,
    ordinal,
    probminhash,
    secrets,
    sharding,
    substrings,
    token_orc,
    topk,
    vector_codes,
    warc,
)

#: Query vectors of the top-k search: ids divisible by this.
QUERY_STEP = 50
TOP = 5

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_secret_scan(spark, folder):
    return secrets.span_digest(secrets.scan_secrets(table(spark, folder, "documents")))


@query
def op2_token_orc(spark, folder):
    return token_orc.token_digest(spark, token_orc.write_tokens(table(spark, folder, "documents")))


@query
def op3_pfair_mixing(spark, folder):
    mixed = mixing.schedule(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "block", "release", "deadline", "slot", "place")


@query
def op4_spaced_seed_overlaps(spark, folder):
    return decontam.find_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_hypergeometric_shards(spark, folder):
    return sharding.shuffle_into_shards(table(spark, folder, "documents"))


@query
def op6_probminhash_dedup(spark, folder):
    return probminhash.near_duplicates(table(spark, folder, "documents"))


@query
def op7_sorted_list_topk(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, TOP)


@query
def op8_ordinal_quality(spark, folder):
    docs = table(spark, folder, "documents")
    return ordinal.grade(docs, ordinal.fit(docs, table(spark, folder, "labels")))


@query
def op9_line_block_text(spark, folder):
    return html_text.extract_text(table(spark, folder, "pages"))


@query
def op10_seekable_warc(spark, folder):
    records = warc.read_archives(warc.write_archives(table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_limb_vector_codes(spark, folder):
    return vector_codes.vector_codes(table(spark, folder, "embeddings"))


@query
def op12_rabin_karp_substrings(spark, folder):
    return substrings.removal_digest(substrings.remove_repeats(table(spark, folder, "documents")))


@query
def op13_bitmap_merkle(spark, folder):
    docs = table(spark, folder, "documents")
    return merkle.manifest(merkle.document_leaves(docs, merkle.every_seventh(F.col("doc_id"))))


def _merkle_sql() -> str:
    """Leaves, then two recursions for each tree: nodes upwards, and every leaf's fold with its siblings."""

    def leaf(n_chars: str) -> str:
        def coded(x):
            return f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"

        return f"sha256({' || '.join(coded(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"

    def nodes(name: str, start: str) -> str:
        return f"""{name} as (
            {start}
            union all
            select grp, level + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (any_value(n) + 1) // 2
            from {name} where n > 1 group by grp, level, pos // 2
        )"""

    def folds(name: str, start: str, tree: str) -> str:
        return f"""{name} as (
            {start}
            union all
            select f.row_no, f.grp, f.level + 1, f.pos // 2, (f.n + 1) // 2, f.path || coalesce(s.node, ''),
                   sha256(case when s.node is null then f.node when f.pos % 2 = 1 then s.node || f.node else f.node || s.node end)
            from {name} f left join {tree} s on s.grp = f.grp and s.level = f.level and s.pos = xor(f.pos, 1)
            where f.n > 1
        )"""

    return f"""with recursive d as (
            select row_number() over () as row_no, doc_id, coalesce('1' || lang, '0') as grp, {leaf("n_chars")} as leaf,
                   case when n_chars is not null and xor(list_reduce(list_prepend(4294967295,
                       list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                           lambda e, i: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295) % 7 = 0
                   then {leaf("cast(n_chars as hugeint) + 1")} end as tampered
            from documents
        ), p as (
            select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos,
                   count(*) over (partition by grp) as n from d
        ), {nodes("t", "select grp, 0 as level, pos, leaf as node, n from p")},
        g as (
            select grp, node as subroot, row_number() over (order by grp) - 1 as pos, count(*) over () as n from t where n = 1
        ), {nodes("u", "select '' as grp, 0 as level, pos, subroot as node, n from g")},
        {folds("f", "select row_no, grp, 0 as level, pos, n, '' as path, coalesce(tampered, leaf) as node from p", "t")},
        {folds("r", "select f.row_no, '' as grp, 0 as level, g.pos, g.n, f.path, f.node from f join g on f.grp = g.grp where f.n = 1", "u")}
        select p.doc_id, p.leaf, g.subroot, u.node as root, sha256(r.path) as proof_sha256, r.node as folded_root,
               r.node = u.node as verified
        from p join g on p.grp = g.grp join u on u.n = 1 join r on r.row_no = p.row_no and r.n = 1"""


def _vector_codes_sql(width: int = 64) -> str:
    """The rounds of ``op11_limb_vector_codes`` one after another, for vectors of one length."""
    part = width // vector_codes.PARTS
    steps = [
        f"""v as (
            select vec_id, label, list_transform(embedding, lambda x: cast(floor({vector_codes.SCALE} * cast(x as double)) as bigint)) as c
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
        ), s as materialized (
            select vec_id, cast(n // {part} as int) as part, cast(n % {part} as int) as pos, c[n + 1] as c
            from v, unnest(range({width})) as u(n)
        ), b0 as materialized (
            select part, cast(f.entry as int) as entry, pos, c
            from (select vec_id, row_number() over (order by vec_id) - 1 as entry from v
                  order by vec_id limit {vector_codes.ENTRIES}) f join s using (vec_id)
        )"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""a{k} as materialized (
            select vec_id, part, min((d, entry)) as best from (
                select s.vec_id, s.part, b.entry, cast(sum((s.c - b.c) * (s.c - b.c)) as bigint) as d
                from s join b{k} b on s.part = b.part and s.pos = b.pos group by all
            ) group by all
        )""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""m{k} as (
                select s.part, a.best[2] as entry, s.pos, cast(sum(s.c) as bigint) as t, count(*) as n
                from s join a{k} a on a.vec_id = s.vec_id and a.part = s.part group by all
            ), b{k + 1} as materialized (
                select b.part, b.entry, b.pos, coalesce((m.t - ((m.t % m.n) + m.n) % m.n) // m.n, b.c) as c
                from b{k} b left join m{k} m on m.part = b.part and m.entry = b.entry and m.pos = b.pos
            )""")
    last = vector_codes.ROUNDS
    return f"""with {", ".join(steps)}, e as (
            select vec_id, string_agg(printf('%02x', a.best[2]), '' order by part) as code, cast(sum(a.best[1]) as bigint) as error
            from a{last} a group by vec_id
        ), books as (
            select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from b{last}
        )
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from e join v using (vec_id), books"""


ORACLE_SQL = {
    "op13_bitmap_merkle": _merkle_sql(),
    "op11_limb_vector_codes": _vector_codes_sql(),
    "op12_rabin_karp_substrings": r"""
        with d as (
            select row_number() over () as row_no, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
        ), w as (
            select row_no, doc_id, p.place, list_slice(words, p.place, p.place + 12) as seq
            from d, unnest(range(1, len(words) - 11)) as p(place) where doc_id is not null
        ), marked as (
            select row_no, place, doc_id, min(doc_id) over (partition by seq) as least from w
        ), gone as (
            select distinct row_no, unnest(range(place, place + 13)) as place from marked where least < doc_id
        ), lists as (
            select row_no, list(place) as places from gone group by row_no
        ), k as (
            select doc_id, words, list_filter(words, lambda x, i: not list_contains(coalesce(places, []), i)) as kept
            from d left join lists using (row_no)
        )
        select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - len(kept) as bigint) as n_removed,
               sha256(array_to_string(kept, ' ')) as kept_sha256 from k""",
    # The text of pages that mark their article and use only p, h1, b and br in it, as those of the tables do.
    "op9_line_block_text": r"""
        with a as (
            select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') as body from pages
        ), b as (
            select page_id, url, string_split_regex(body, '</?(?:p|h1)>') as blocks from a
        ), t as (
            select page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x: trim(regexp_replace(
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '</?(?:b|br)>', ' ', 'g'),
                    '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
                '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text
            from b
        )
        select page_id, url, text, cast(length(text) as bigint) as n_chars from t""",
    "op7_sorted_list_topk": f"""
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c
            from embeddings
            where embedding is not null and vec_id is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
        ), queries as (
            select vec_id, min(c) as c from v where vec_id % {QUERY_STEP} = 0 group by vec_id
        ), scored as (
            select q.vec_id as query_id, p.vec_id,
                   cast(list_sum(list_transform(list_zip(q.c, p.c), lambda z: z[1] * z[2])) as bigint) as score
            from queries q join v p on p.vec_id <> q.vec_id and len(p.c) = len(q.c)
        ), ranked as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
                   vec_id, score
            from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= {TOP}""",
    "op10_seekable_warc": """
        with p as (
            select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages
        ), d as (
            select page_id, strlen(payload) as payload_bytes, h, max(page_id) over (partition by h) as response from p
        )
        select page_id, cast(payload_bytes as bigint) as payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + cast(((cast('0x' || substr(h, cast((i // 4) * 5 + 1 as bigint), 5) as bigint)
                       >> cast(15 - 5 * (i % 4) as bigint)) & 31) as bigint), 1)), '') as payload_digest,
               case when page_id = response then 'response' else 'revisit' end as record_type,
               case when page_id = response then null else response end as refers_to
        from d""",
}
