"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm import conversations, decontaminate, importance, language, lines, mixture, neardup, quality, secrets, sharding, tokens, toxicity, urls
from trigrove.plans.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in a window of a benchmark item."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@registered
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of weights 5, 2, 1 takes of every document, and when its first copy comes."""
    found = mixture.mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("first_position", 9).alias("first_position"))


@registered
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document by 3-word shingles at a similarity of 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@registered
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, likelihood score and verdict of every document."""
    good = quality.trusted(table(spark, sf_dir, "labels"))
    found = quality.judged(table(spark, sf_dir, "documents"), good, keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@registered
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a clause grammar learned from labels."""
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", "held_out", "score", "predicted")


@registered
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand in five sources or more."""
    found = lines.without_boilerplate(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("clean_text", F.lit(""))).alias("clean_md5"))


@registered
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: those of the fixed patterns, and those that the random field adds."""
    found = secrets.scanned(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    kinds = F.transform("spans", lambda s: s["kind"])
    counted = {f"n_{k}": (F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long") for k in ("assign", "access", "hex")}
    texts = {"base_sha256": F.sha2(secrets.joined(base), 256), "all": secrets.joined(F.col("spans"))}
    return found.withColumns(counted | texts).select("doc_id", *counted, "base_sha256", F.col("all").alias("spans"))


@registered
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    found = language.predicted(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


@registered
def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards differ by one row at most."""
    found = sharding.sharded(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    body = F.coalesce("text", F.lit(""))  # of the text that came to the shard
    return found.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registered
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's address."""
    found = urls.judged(table(spark, sf_dir, "pages"), keep=["page_id"])
    return found.select("page_id", "host", "path", "rule", "verdict")


@registered
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    repaired, counted = conversations.repaired(conversations.damaged(rows), copies=F.col("copies"))
    digest = conversations.digest(repaired)
    counts = [F.coalesce(F.col(f"counted.{c}"), F.lit(0).cast("long")).alias(c) for c in conversations.COUNTS]
    return (
        rows.select("conv_id").distinct().alias("all")
        .join(counted.alias("counted"), F.col("all.conv_id").eqNullSafe(F.col("counted.conv_id")), "left")
        .join(digest.alias("digest"), F.col("all.conv_id").eqNullSafe(F.col("digest.conv_id")), "left")
        .select("all.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    )


@registered
def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's token ids, as read back from the written files."""
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    tokens.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    found = tokens.read_ids(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@registered
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark's n-grams, and the rank of those drawn."""
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL for those that SQL can express.
SQL: dict[str, str] = {
    "op1_decontaminate": r"""
        with docs as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from documents),
        items as (
            select cast(item_id as varchar) as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from benchmark),
        starts as (select id, w, least(len(w), 13) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from items where len(w) > 0),
        phrases as (select distinct id, n, array_to_string(w[k:k + n - 1], ' ') as phrase from starts),
        places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from docs, (select distinct n from phrases) where len(w) >= n),
        met as (select doc_id, k, n, id from (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as phrase from places) join phrases using (n, phrase)),
        hit as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(k, k + n)) as word from met) group by doc_id),
        named as (select doc_id, count(id) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, id from met) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from docs left join hit using (doc_id) left join named using (doc_id)""",
    "op3_near_duplicates": r"""
        with recursive docs as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        starts as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as k from docs where len(w) > 0),
        shingles as (select distinct doc_id, array_to_string(w[k:k + 2], ' ') as shingle from starts),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b using (shingle) where a.doc_id < b.doc_id group by all),
        links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
        ways as (select a, b from links union all select b, a from links),
        reached(node, other) as (select doc_id, doc_id from docs union select node, b from reached join ways on a = other),
        least_of as (select node, min(other) as component_id from reached group by node)
        select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
        from docs d left join sizes using (doc_id) join least_of on node = d.doc_id""",
    "op2_mix_sources": r"""
        with sized as (
            select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as o,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
        sources as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source),
        weighed as (select *, [5.0, 2.0, 1.0][place % 3 + 1]::double as weight, [-0.5, 0.0, 0.5][place % 3 + 1]::double as ramp, 3 * source_size as cap from sources),
        levels as (
            select *, (cast(sum(source_size) over () as double) - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from weighed),
        goals as (select source, source_size, ramp, least(cast(cap as double), max(level) over () * weight) as target from levels),
        placed as (
            select s.doc_id, s.size, g.*, cast(coalesce(sum(s.size) over (partition by s.source order by s.o, s.size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
            from sized s join goals g on s.source is not distinct from g.source),
        passed as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes from placed),
        counted as (
            select *, passes + case when source_size > 0 and passes < 3 and 2 * start + size <= 2 * (target - passes * source_size) then 1 else 0 end as copies from passed),
        parts as (select *, least((start + size / 2.0::double) / target, 1.0) as part from counted)
        select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, cast(copies as bigint) as copies,
               case when copies > 0 then round(2 * part / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * part)), 9) end as first_position
        from parts""",
    "op6_line_dedup": r"""
        with lines as (
            select doc_id, coalesce('=' || source, '-') as site, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as position
            from documents where text is not null),
        spread as (select trim(line) as line from lines where trim(line) <> '' group by trim(line) having count(distinct site) >= 5),
        judged as (select l.*, s.line is not null as removed, trim(l.line) <> '' as counted from lines l left join spread s on trim(l.line) = s.line),
        cleaned as (
            select doc_id, cast(count(*) filter (where counted) as bigint) as n_lines, cast(count(*) filter (where removed) as bigint) as n_removed,
                   coalesce(string_agg(line, chr(10) order by position) filter (where not removed), '') as clean from judged group by doc_id)
        select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, md5(coalesce(clean, '')) as clean_md5
        from documents d left join cleaned c using (doc_id)""",
    "op11_conversation_repair": r"""
        with spaced as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
        bits as (select list(list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) order by i) as t from range(256) r(i)),
        faulty as (select conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(key, ''), lambda c: cast(ascii(c) as bigint)),
                lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 20 as fault from spaced, bits),
        damaged as (
            select conv_id, turn, case fault when 4 then 'user' else role end as role, case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
                   unnest(range(case fault when 0 then 0 when 3 then 2 else 1 end)) as copy from faulty),
        placed as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i,
                   right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as final, left(role, 1) as initial from damaged),
        marked as (
            select *, final = '' as blank, final <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as again,
                   initial || lead(initial) over (partition by conv_id order by i) not in ('su', 'ua', 'au') as clash from placed),
        rows as (select *, not blank and not again and final not in ('.', '!', '?') as cut from marked),
        held as (
            select conv_id, count(*) filter (where blank) as blank, count(*) filter (where again) as duplicate, count(*) filter (where cut) as truncated,
                   count(*) filter (where clash) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                   list({'gone': blank or again, 'more': case when cut then 1 else 0 end, 'initial': initial, 'role': role, 'text': text} order by i) as turns
            from rows group by conv_id),
        far as (select {'c': 1000000000, 'a': '', 't': ''} as x),
        paid as (
            select h.*, list_reduce(turns, lambda s, r: list_transform([{
                'n': {'c': s.n.c + 3, 'a': s.n.a || 'D', 't': s.n.t},
                's': least({'c': s.s.c + 3, 'a': s.s.a || 'D', 't': s.s.t},
                    case when r.initial = 's' and not r.gone then {'c': s.n.c + r.more, 'a': s.n.a || 'K', 't': s.n.t || chr(10) || r.role || ':' || r.text} else x end),
                'u': least({'c': s.u.c + 3, 'a': s.u.a || 'D', 't': s.u.t},
                    case when r.gone then x else list_min(list_transform([s.n, s.s, s.a], lambda b: least(
                        {'c': b.c + r.more + 2, 'a': b.a || 'R', 't': b.t || chr(10) || 'user:' || r.text},
                        case when r.initial = 'u' then {'c': b.c + r.more, 'a': b.a || 'K', 't': b.t || chr(10) || r.role || ':' || r.text} else x end))) end),
                'a': least({'c': s.a.c + 3, 'a': s.a.a || 'D', 't': s.a.t},
                    case when r.gone then x else least(
                        {'c': s.u.c + r.more + 2, 'a': s.u.a || 'R', 't': s.u.t || chr(10) || 'assistant:' || r.text},
                        case when r.initial = 'a' then {'c': s.u.c + r.more, 'a': s.u.a || 'K', 't': s.u.t || chr(10) || r.role || ':' || r.text} else x end) end)
                }], lambda p: list_transform([list_min(list_concat([p.u], list_transform([p.n, p.s, p.a], lambda b: {'c': b.c + 2, 'a': b.a || 'I', 't': b.t || chr(10) || 'user:'})))],
                    lambda u: {'n': p.n, 's': p.s, 'u': u, 'a': least(p.a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'})})[1])[1],
                {'n': {'c': 0, 'a': '', 't': ''}, 's': x, 'u': {'c': 2, 'a': 'I', 't': chr(10) || 'user:'}, 'a': {'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}) as s
            from held h, far),
        done as (select *, least(s.n, s.a) as best from paid)
        select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit, sha256(coalesce(substr(best.t, 2), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join done d on o.conv_id is not distinct from d.conv_id""",
    "op13_importance": r"""
        with words as (
            select true as doc, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
            union all
            select false, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
        starts as (select doc, id, w, unnest(range(1, len(w) + 1)) as k from words),
        grams as (select doc, id, array_to_string(w[k:k + n - 1], ' ') as gram from starts, (select unnest([1, 2, 3]) as n) where k + n - 1 <= len(w)),
        bits as (select list(list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) order by i) as t from range(256) r(i)),
        hashed as (
            select gram, xor(list_reduce(list_transform(range(octet_length(encode(gram))), lambda p: cast('0x' || hex(gram)[2 * p + 1:2 * p + 2] as bigint)),
                lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 10000 as bucket
            from (select distinct gram from grams), bits),
        held as (select doc, id, bucket from grams join hashed using (gram)),
        counts as (select bucket, count(*) filter (where doc) as s, count(*) filter (where not doc) as t from held group by bucket),
        sums as (select cast(sum(s) as double) as s_all, cast(sum(t) as double) as t_all from counts),
        gains as (select bucket, cast(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) as bigint) as gain from counts, sums),
        weights as (select id, count(*) as n_features, cast(sum(gain) as bigint) as weight from held join gains using (bucket) where doc group by id),
        scored as (
            select id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                   coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('42:' || coalesce(cast(id as varchar), ''))[1:8] as bigint) + 0.5::double) / 4294967296))) as bigint) as score
            from words left join weights using (id) where doc),
        placed as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as place, count(*) filter (where n_words >= 20) over () as able from scored)
        select doc_id, n_features, weight, score, case when n_words >= 20 and place <= able * 5 // 100 then place end as rank from placed""",
    "op10_url_filter": r"""
        with parts as (
            select page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') as raw_host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
        named as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
        ruled as (
            select *, case
                when ends_with('.' || host, '.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
                when ends_with('.' || host, '.example.org') and starts_with(path, '/es/') then 'example.org/es/'
                when ends_with('.' || host, '.com') and starts_with(path, '/fr/') then 'com/fr/'
                when ends_with('.' || host, '.com') and starts_with(path, '/de/') then 'com/de/'
                when ends_with('.' || host, '.org') and starts_with(path, '/') then 'org/' end as rule from named)
        select page_id, host, path, rule, case
            when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when contains(host, 'spam-farm') or contains(host, 'cheap-pills') or contains(host, 'free-bets') or contains(host, 'adult-x')
                or (starts_with(path, '/') and ends_with(path, '.exe')) or starts_with(path, '/cgi-bin/') then 'block' else 'allow' end as verdict
        from ruled""",
}
