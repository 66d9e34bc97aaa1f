"""Queries over the tables, by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import NO_DEPENDENCY, Settings
from ..functions import hints, text
from ..functions.storage import kept, shared_folder
from ..operators import chunks, contexts, graph, payloads, reports, reviewer, traversal, units
from ..sources import files as sources
from . import sql as S

DEFAULTS = Settings()


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(os.path.join(d, f"{name}.parquet"))


def _units(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_units")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_units(s, d))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.edges(_units(s, d))


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_files").dropDuplicates(["file_id"])


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").dropDuplicates(["doc_id"])


def _prioritised(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = _nodes(s, d), _edges(s, d)
    return graph.prioritised(n, e), e


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- graph

@query(S.GRAPH + "select id, source_name, target_name, descr, start_line, end_line, name, path, md5(source_code) as code_md5, node_ord from nodes")
def graph_nodes(s, d):
    return _nodes(s, d).select("id", "source_name", "target_name", "descr", "start_line", "end_line", "name", "path", F.md5("source_code").alias("code_md5"), "node_ord")


@query(S.GRAPH + "select src, dst, edge_ord from edges")
def graph_edges(s, d):
    return _edges(s, d).select("src", "dst", "edge_ord")


@query(S.GRAPH + "select id, in_degree, out_degree from deg")
def graph_degrees(s, d):
    return graph.degrees(_nodes(s, d), _edges(s, d))


@query(S.GRAPH + "select (select count(*) from nodes) as n_nodes, (select count(*) from edges) as n_edges, (select count(*) from nodes where source_code <> '') as n_source")
def graph_counts(s, d):
    rows = _nodes(s, d).select(F.lit(1).alias("n"), F.lit(0).alias("e"), (F.col("source_code") != "").cast("int").alias("c")).unionByName(_edges(s, d).select(F.lit(0).alias("n"), F.lit(1).alias("e"), F.lit(0).alias("c")))
    return rows.agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"), F.sum("c").alias("n_source"))


@query(S.HINTS + "select id, kind, len(hits) as n_hits, array_to_string(hits, ' | ') as hits from hit_list where len(hits) > 0")
def hint_tokens(s, d):
    rows = graph.hinted(_nodes(s, d))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_hits").alias("h")) for k in hints.KINDS]))
    return rows.select("id", each.alias("x")).where(F.size("x.h") > 0).select("id", "x.kind", F.size("x.h").cast("long").alias("n_hits"), F.array_join("x.h", " | ").alias("hits"))


@query(S.HINTS + "select id, input_count, sink_count, validation_count, safety_count, input_count > 0 as has_input, sink_count > 0 as has_sink, validation_count > 0 as has_validation, safety_count > 0 as has_safety, n_lines from profile")
def hint_profile(s, d):
    p = graph.profile(_nodes(s, d))
    return p.select("id", *[F.col(f"{k}_count").cast("long").alias(f"{k}_count") for k in hints.KINDS], *[f"has_{k}" for k in hints.KINDS], F.col("n_lines").cast("long").alias("n_lines"))


@query(S.HINTS + "select path, count(*) as nodes, cast(sum(hint_score) as bigint) as hint_score, cast(max(hint_score) as bigint) as top_score from profile group by path")
def hint_score(s, d):
    p = graph.profile(_nodes(s, d))
    return p.groupBy("path").agg(F.count("*").alias("nodes"), F.sum("hint_score").alias("hint_score"), F.max("hint_score").cast("long").alias("top_score"))


@query(S.HINTS + "select id, priority from prio order by priority desc, id limit 20")
def node_priority_topk(s, d):
    p, _ = _prioritised(s, d)
    return p.select("id", F.col("priority").cast("long").alias("priority")).orderBy(F.desc("priority"), "id").limit(20)


@query(S.HINTS + "select id, in_degree, out_degree, hint_score, n_lines, priority from prio")
def node_priority(s, d):
    p, _ = _prioritised(s, d)
    return p.select("id", *[F.col(c).cast("long").alias(c) for c in ("in_degree", "out_degree", "hint_score", "n_lines", "priority")])


# ---------------------------------------------------------------- paths and trees

@query(S.PATHS + "select root, target, n_nodes, chain, priority from best")
def direct_paths_depth2(s, d):
    p, e = _prioritised(s, d)
    return traversal.directed_paths(p, e, 2).select("root", "target", F.col("n_nodes").cast("long").alias("n_nodes"), "chain", "priority")


@query(S.PATHS + "select root, target, ic as input_count, sc as sink_count, vc as validation_count, fc as safety_count from best")
def path_summary(s, d):
    p, e = _prioritised(s, d)
    rows = traversal.directed_paths(p, e, 2)
    return rows.select("root", "target", *[F.col(c).cast("long").alias(c) for c in traversal.COUNTS])


@query(S.INBOUND)
def inbound_paths_depth3(s, d):
    p, e = _prioritised(s, d)
    return traversal.directed_paths(p, e, 3, reverse=True).select("root", "target", F.col("n_nodes").cast("long").alias("n_nodes"), "chain", *[F.col(c).cast("long").alias(c) for c in traversal.COUNTS], "priority")


@query(S.RANKED + "select root, rank, kind, array_to_string(nodes, ' -> ') as chain, value as priority from ranked")
def ranked_paths_topk(s, d):
    p, e = _prioritised(s, d)
    return traversal.ranked_paths(p, e, DEFAULTS.context_depth, DEFAULTS.max_focus_paths).withColumn("rank", F.col("rank").cast("long"))


def _kept(s, d):
    """Priorities and edges that a query reads more than once: the hints are found once."""
    p, e = _prioritised(s, d)
    return kept(p), e


def _local(s, d):
    p, e = _kept(s, d)
    return p, e, traversal.local_nodes(p, e, DEFAULTS.context_depth, DEFAULTS.max_nodes, DEFAULTS.max_focus_paths)


@query(S.LOCAL + "select root, ord, id from local")
def local_nodes(s, d):
    return _local(s, d)[2].withColumn("ord", F.col("ord").cast("long"))


@query(S.LOCAL + "select root, n_nodes, cast(input_nodes as bigint) as input_nodes, cast(sink_nodes as bigint) as sink_nodes, cast(validation_nodes as bigint) as validation_nodes, cast(safety_nodes as bigint) as safety_nodes, cast(combined_nodes as bigint) as combined_nodes from summary")
def local_summary(s, d):
    p, _, local = _local(s, d)
    return traversal.local_summary(local, p)


def _prescreen(s, d):
    p, _, local = _local(s, d)
    return p, traversal.prescreened(p, traversal.local_summary(local, p), DEFAULTS.candidate_threshold)


@query(S.LOCAL + "select id, cast(score as bigint) as prescreen_score, signal or score >= 8 as is_candidate, n_nodes as n_local from screened")
def prescreen(s, d):
    return _prescreen(s, d)[1].withColumn("prescreen_score", F.col("prescreen_score").cast("long"))


@query()
def dependency_trees(s, d):
    p, e = _prioritised(s, d)
    return traversal.trees(p, e, DEFAULTS.context_depth, DEFAULTS.max_nodes, DEFAULTS.max_branches)


@query()
def tree_score_topk(s, d):
    p, e = _kept(s, d)
    t = traversal.trees(p, e, DEFAULTS.context_depth, DEFAULTS.max_nodes, DEFAULTS.max_branches)
    top = traversal.global_trees(t, max(30, 3 * DEFAULTS.max_nodes))
    return traversal.tree_scores(top, p).orderBy(F.desc("tree_score"), "root")


# ---------------------------------------------------------------- payloads

@query(S.LOCAL + "select id, cast(5 * hint_score + in_degree + out_degree + 2 * n_nodes + n_lines + score as bigint) as payload_score from screened")
def node_payload_score(s, d):
    p, pre = _prescreen(s, d)
    return payloads.node_scores(p, pre).withColumn("payload_score", F.col("payload_score").cast("long"))


def _context_nodes(s, d):
    n, e = _nodes(s, d), _edges(s, d)
    return contexts.nodes_with_texts(n, e), e


def _contexts(nodes, e, limit):
    return contexts.local_contexts(nodes, e, DEFAULTS.context_depth, DEFAULTS.max_nodes, DEFAULTS.max_focus_paths, limit)


@query(S.CONTEXTS + f"select root, cast({DEFAULTS.context_depth} as bigint) as depth, cast({DEFAULTS.max_nodes} as bigint) as node_limit, tokens as message_tokens, sha256(payload) as payload_sig, n_nodes from written where tokens <= {text.input_limit(DEFAULTS.max_input_tokens, None)}")
def payload_contexts(s, d):
    rows = _contexts(*_context_nodes(s, d), text.input_limit(DEFAULTS.max_input_tokens, None))
    return rows.select("root", F.col("depth").cast("long").alias("depth"), F.col("node_limit").cast("long").alias("node_limit"), "message_tokens", payloads.signature(F.col("payload")).alias("payload_sig"), F.size("nodes").cast("long").alias("n_nodes"))


#: Small enough that most contexts must shrink.
TIGHT_TOKENS = 900


@query()
def budget_shrink(s, d):
    rows = _contexts(*_context_nodes(s, d), TIGHT_TOKENS)
    return rows.select("root", F.col("depth").cast("long").alias("depth"), F.col("node_limit").cast("long").alias("node_limit"), F.col("message_tokens").alias("tokens"), F.size("nodes").cast("long").alias("n_nodes"))


def _tree_payloads(s, d, nodes, e, limit):
    """Contexts of the best trees with their scores, copies of a payload left out."""
    t = traversal.trees(nodes, e, DEFAULTS.context_depth, DEFAULTS.max_nodes, DEFAULTS.max_branches)
    top = kept(traversal.global_trees(t, max(30, 3 * DEFAULTS.max_nodes)))
    ctx = contexts.tree_contexts(nodes, e, top.select("root"), DEFAULTS.context_depth, DEFAULTS.max_nodes, DEFAULTS.max_branches, DEFAULTS.max_focus_paths, limit)
    place = top.select("root", F.struct(-F.col("tree_priority"), -F.size("branches"), -F.size("nodes"), "root").alias("_o"))
    rows = ctx.join(traversal.tree_scores(top, nodes), "root").join(place, "root")
    rows = rows.select("root", F.col("tree_score").cast("long").alias("score"), F.col("message_tokens").alias("tokens"), "_o", payloads.signature(F.col("payload")).alias("payload_sig"))
    rows = payloads.first_per_signature(rows, ["payload_sig"], ["_o"], DEFAULTS.tree_dedup_limit)
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("_o")).cast("long")).drop("_o")  # the best trees, a few dozen


@query()
def tree_contexts(s, d):
    nodes, e = _context_nodes(s, d)
    return _tree_payloads(s, d, kept(nodes), e, text.input_limit(DEFAULTS.max_input_tokens, None))


@query()
def payload_order(s, d):
    """Tree and node payloads, the latter of the pre-screened candidates and those that the floor adds, merged in the order of review."""
    n, e = _nodes(s, d), _edges(s, d)
    nodes = kept(contexts.nodes_with_texts(n, e))
    limit = text.input_limit(DEFAULTS.max_input_tokens, None)
    local = traversal.local_nodes(nodes, e, DEFAULTS.context_depth, DEFAULTS.max_nodes, DEFAULTS.max_focus_paths)
    pre = kept(traversal.prescreened(nodes, traversal.local_summary(local, nodes), DEFAULTS.candidate_threshold))
    chosen = payloads.with_floor(pre.select("id", F.col("prescreen_score").alias("score"), "is_candidate")).select("id", "relaxed")
    ctx = _contexts(nodes, e, limit).withColumnRenamed("root", "id").select("id", "message_tokens", F.size("nodes").alias("n_local"), F.array_join(F.array_sort("nodes"), ",").alias("local"), payloads.signature(F.col("payload")).alias("payload_sig"))
    rows = chosen.join(ctx, "id").join(n.select("id", "path", F.col("node_ord").alias("ord"), payloads.signature(F.concat_ws("||", "path", "source_name", "target_name", "descr", "source_code")).alias("own_sig")), "id")
    rows = payloads.both_signatures(rows.withColumn("context_sig", payloads.signature(F.concat_ws("||", "own_sig", "local"))), DEFAULTS.node_dedup_limit)
    scores = payloads.node_scores(nodes, pre.drop("n_local").join(rows.select("id", "n_local"), "id"))
    node_rows = rows.join(scores, "id").select(F.col("id").alias("root"), F.col("payload_score").cast("long").alias("score"), F.col("message_tokens").alias("tokens"), "ord", "payload_sig")
    return contexts.merged(_tree_payloads(s, d, nodes, e, limit), node_rows, DEFAULTS.final_dedup_limit)


@query(S.GRAPH + "select id, sig from (select id, sha256(source_code) as sig, row_number() over (partition by source_code order by length(id), id) as n from nodes where source_code <> '') t where n <= 2")
def payload_dedup_topn(s, d):
    rows = _nodes(s, d).where("source_code <> ''").select("id", payloads.signature(F.col("source_code")).alias("sig"))
    return payloads.first_per_signature(rows, ["sig"], [F.length("id"), "id"], 2)


@query(S.HINTS + """, c as (select id, hint_score as score, hint_score >= 60 as is_candidate from profile p where has_source),
  k as (select count(*) as s, count(*) filter (where is_candidate) as kept from c),
  r as (select id, score, row_number() over (order by score desc, id) as n from c where not is_candidate)
select id, score, false as relaxed from c where is_candidate union all
select id, score, true from r, k where n <= greatest(0, least(s, greatest(10, s // 3)) - kept)""")
def candidate_floor(s, d):
    rows = graph.profile(_nodes(s, d)).where("has_source").select("id", F.col("hint_score").cast("long").alias("score"), (F.col("hint_score") >= 60).alias("is_candidate"))
    return payloads.with_floor(rows).select("id", "score", "relaxed")


@query(S.DEDUP_BOTH)
def payload_dedup_both(s, d):
    n = _nodes(s, d)
    ctx = _contexts(*_context_nodes(s, d), None).select(F.col("root").alias("id"), "nodes", payloads.signature(F.col("payload")).alias("payload_sig"))
    rows = n.join(ctx, "id").select("path", F.col("node_ord").alias("ord"), "id", "payload_sig", payloads.context_signature(F.col("nodes")).alias("context_sig"))
    return payloads.both_signatures(rows, DEFAULTS.node_dedup_limit)


@query(S.GRAPH + "select id, sha256(concat_ws('||', path, source_name, target_name, descr, source_code, id)) as sig from nodes where source_code <> ''")
def context_signature(s, d):
    return _nodes(s, d).where("source_code <> ''").select("id", payloads.context_signature(F.array("id")).alias("sig"))


@query("select unit_id, sha256(source_code) as sha, md5(source_code) as md5 from (select distinct unit_id, source_code from code_units) t")
def payload_signature(s, d):
    return _units(s, d).select("unit_id", "source_code").distinct().select("unit_id", payloads.signature(F.col("source_code")).alias("sha"), F.md5("source_code").alias("md5"))


@query("select doc_id, md5(text) as md5 from (select distinct doc_id, text from documents where text is not null) t")
def md5_text(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.md5("text").alias("md5"))


@query("""with f as (select distinct repo, len(string_split(path, '/')) as depth, path, sha256(coalesce(path, '') || chr(0) || coalesce(extension, '') || chr(0) || coalesce(source_code, '')) as digest from source_files)
  , p as (select *, row_number() over (partition by repo order by depth, encode(path), digest) - 1 as n from f),
  b as (select repo, n // 4096 as block, sha256(string_agg(digest, '' order by n)) as digest from p group by 1, 2)
select repo, sha256(string_agg(digest, '' order by block)) as project_hash from b group by repo""")
def project_hash(s, d):
    return sources.project_hashes(table(s, d, "source_files"), "repo")


# ---------------------------------------------------------------- text

@query(S.LINES + "select file_id, cast(n as int) as line_no, ls[n] as line from f, unnest(range(1, len(ls) + 1)) as u(n)")
def doc_lines(s, d):
    return chunks.file_lines(_files(s, d).where("source_code is not null"))


@query(S.LINES + "select file_id, case when len(ls) = 0 then '' else array_to_string(list_transform(range(1, len(ls) + 1), lambda k : lpad(cast(k + first - 1 as varchar), cast(length(cast(first + len(ls) - 1 as varchar)) as int), ' ') || ': ' || ls[k]), chr(10)) end as listing from f")
def numbered_lines(s, d):
    return chunks.listings(_files(s, d))


@query(S.LINES + "select file_id, case when first + 2 - first + 1 >= 1 and 6 <= len(ls) then array_to_string(ls[3:6], chr(10)) else '' end as slice from f")
def line_slice(s, d):
    first = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    return _files(s, d).where("source_code is not null").select("file_id", text.line_slice(F.col("source_code"), first + 2, first + 5, first).alias("slice"))


@query(S.sections(chunks.BOUNDARIES))
def semantic_sections(s, d):
    return chunks.sections(_files(s, d))


@query(S.packed(chunks.BOUNDARIES, 400, False))
def chunk_pack(s, d):
    return chunks.chunks(_files(s, d), 400).drop("chunk")


@query(S.packed(chunks.BOUNDARIES, 40, True))
def chunk_lines(s, d):
    return chunks.chunks(_files(s, d), 40, isolate=True).drop("chunk")


@query("select doc_id, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) as tokens from (select distinct doc_id, text from documents) t")
def token_estimate(s, d):
    return _docs(s, d).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("select doc_id, cast(ceil(length('system: ' || 'review') / 4.0) + ceil(length('user: ' || text) / 4.0) as bigint) as tokens from (select distinct doc_id, text from documents where text is not null) t")
def message_tokens(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", text.message_tokens(F.lit("review"), F.col("text")).alias("tokens"))


@query("select doc_id, cast(greatest(128, least(8000, 9000) - cast(ceil(length(text) / 4.0) as bigint) - 512 - 64) as bigint) as budget from (select distinct doc_id, text from documents where text is not null) t")
def text_budget(s, d):
    limit = text.input_limit(9000, 8000)
    return _docs(s, d).where("text is not null").select("doc_id", text.text_budget(F.lit(limit), text.token_estimate(F.col("text")), 512, 64).alias("budget"))


@query("select doc_id, cast(ceil(length('user: ' || text) / 4.0) as bigint) + 20 as message_tokens from (select distinct doc_id, text from documents where text is not null) t where ceil(length('user: ' || text) / 4.0) + 20 <= 300")
def budget_fit(s, d):
    rows = _docs(s, d).where("text is not null").select("doc_id", F.col("text").alias("payload"))
    return payloads.fits(rows, 20, 300).select("doc_id", "message_tokens")


@query("select distinct lower(regexp_replace(trim(coalesce(source, '')), '[^A-Za-z0-9_.-]+', '_', 'g')) as raw, case when trim(regexp_replace(trim(coalesce(source, '')), '[^A-Za-z0-9_.-]+', '_', 'g'), '._') = '' then 'project' else trim(regexp_replace(trim(coalesce(source, '')), '[^A-Za-z0-9_.-]+', '_', 'g'), '._') end as name from documents")
def name_sanitizer(s, d):
    c = F.coalesce("source", F.lit(""))
    return table(s, d, "documents").select(F.lower(F.regexp_replace(F.trim(c), r"(?U)[^\w.-]+", "_")).alias("raw"), text.sanitized_name(c).alias("name")).distinct()


# ---------------------------------------------------------------- scan, extraction, validation

@query(S.scan_filters(DEFAULTS))
def scan_filters(s, d):
    rows = _files(s, d).withColumn("size", F.octet_length(F.coalesce("source_code", F.lit(""))))
    return rows.where(sources.wanted(F.col("path"), F.col("size"), Settings(max_file_mb=4096 / 1048576))).select("file_id")


@query("select file_id, sha256(replace(replace(source_code, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as sha from (select distinct file_id, source_code from source_files where source_code is not null) t")
def encoding_decode(s, d):
    rows = _files(s, d).where("source_code is not null").select("file_id", F.encode("source_code", "utf-8").alias("content"))
    return rows.select("file_id", F.sha2(sources.decoded(F.col("content")), 256).alias("sha"))


@query("select path, '//' || path || chr(10) || '<code>' || chr(10) || source_code || chr(10) || '</code>' as block from (select distinct file_id, path, source_code from source_files where source_code is not null) t")
def text_export(s, d):
    return sources.as_export(_files(s, d).where("source_code is not null"))


@query("""with f as (select distinct file_id, repo, path from source_files), n as (select path, len(string_split(path, '/')) as depth, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, repo, file_id from f)
select file_id, row_number() over (partition by repo order by depth, encode(dir), encode(path), file_id) as pos from n""")
def breadth_first_order(s, d):
    return sources.breadth_first(_files(s, d).select("file_id", "repo", "path"), "repo", "file_id").select("file_id", "pos")


@query(S.IMPORTS)
def import_targets(s, d):
    return units.imports(_files(s, d))


@query(S.UNIT_LINES)
def unit_line_parse(s, d):
    rows = _units(s, d).dropDuplicates(["unit_id"])
    span = F.when(F.col("unit_id") % 7 == 0, F.lit("x")).otherwise(F.concat_ws("-", F.col("start_code_line").cast("string"), F.col("end_code_line").cast("string")))
    line = F.concat_ws(units.SEP, "source_name", "target_name", F.coalesce("source_desc", F.lit("")), span)
    out = rows.select("unit_id", F.concat(F.lit("```text\n"), line, F.lit("\nnothing here\n```")).alias("output"))
    return units.parse_lines(out).drop("output")


@query(S.VALIDATION)
def unit_validation(s, d):
    return units.validated(_units(s, d)).select("unit_id")


@query(S.natural("source_name") + " as natural_source, " + S.natural("target_name").replace("select unit_id, ", "") + " as natural_target from (select distinct unit_id, source_name, target_name from code_units) t")
def natural_language_test(s, d):
    return _units(s, d).dropDuplicates(["unit_id"]).select("unit_id", units.is_natural_language(F.col("source_name")).alias("natural_source"), units.is_natural_language(F.col("target_name")).alias("natural_target"))


@query(f"select unit_id, {S.SUPPORT} as supported from (select distinct unit_id, target_name, source_code from code_units) t")
def target_support(s, d):
    return _units(s, d).dropDuplicates(["unit_id"]).select("unit_id", units.is_supported(F.col("target_name"), F.col("source_code")).alias("supported"))


@query()
def extract_units(s, d):
    return units.extracted(_files(s, d)).drop("source_code")


@query()
def extract_coverage(s, d):
    return units.extracted(_files(s, d)).groupBy("status").agg(F.countDistinct("file_id").alias("files"), F.count("source_name").alias("units"))


# ---------------------------------------------------------------- reports

def _report_texts(s, d) -> DataFrame:
    """One structured report per section of the findings table."""
    f = table(s, d, "findings").dropDuplicates(["finding_id"])
    none = lambda c: F.coalesce(c, F.lit(""))
    level = F.element_at(F.array(F.lit("高危"), F.lit("中危"), F.lit("低危"), F.lit("low")), (F.col("finding_id") % 4 + 1).cast("int"))
    block = F.concat(F.lit("<文件>\n路径: "), "file_path", F.lit("\n结论: 发现漏洞\n<漏洞>\n类型: "), F.coalesce("type", F.lit("x")), F.lit("\n判定: 可疑\n等级: "), level, F.lit("\n位置: "), F.when(none(F.col("location")) == "", "-").otherwise(F.col("location")),
                     *[F.concat(F.lit(f"\n<{t}>\n"), none(F.col(c)), F.lit(f"\n</{t}>")) for c, t in reports.TAGS.items()], F.lit("\n</漏洞>\n</文件>"))
    return f.select("finding_id", F.concat(F.lit("\n\n" + reports.SEPARATOR + "\n<审计报告>\n"), block, F.lit("\n</审计报告>\n"), F.when(F.col("finding_id") % 5 == 0, reports.SEPARATOR + "\n<审计报告>\n<文件>\n路径: /ok\n结论: 审计通过\n</文件>\n</审计报告>").otherwise("")).alias("report"))


@query(S.FINDINGS + "select finding_id, 1 as section_no, false as passes from f union all select finding_id, 2, true from f where finding_id % 5 = 0")
def report_sections(s, d):
    rows = reports.split_sections(_report_texts(s, d))
    verdict = reports.is_pass(reports.line_value(F.col("section"), "结论"))
    return rows.select("finding_id", "section_no", verdict.alias("passes"))


@query(S.FINDINGS + f"""select finding_id, 1 as section_no, file_path, coalesce(type, 'x') || '（可疑 / ' || {S.LEVEL} || '）' as type, case when coalesce(location, '') = '' then '-' else location end as location,
  trim(coalesce(feature, '')) as feature, trim(coalesce(vector, '')) as vector, trim(coalesce(impact, '')) as impact, trim(coalesce(fix, '')) as fix from f
union all select finding_id, 2, '/ok', '审计通过', '-', '', '', '', '' from f where finding_id % 5 = 0""")
def report_findings(s, d):
    return reports.structured(reports.split_sections(_report_texts(s, d))).drop("file_no", "finding_no")


@query(S.FINDINGS + """select finding_id, file_path, cast(1 as bigint) as finding_no, coalesce(type, 'x') as type, coalesce(location, '') as location, trim(feature) || chr(10) || 'more' as feature, coalesce(vector, '') as vector,
  trim(coalesce(impact, '')) || ' and on' as impact, coalesce(fix, '') as fix from f""")
def legacy_findings(s, d):
    f = table(s, d, "findings").dropDuplicates(["finding_id"])
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    section = F.concat(F.lit("// "), "file_path", F.lit("\n■ 漏洞类型："), F.coalesce("type", F.lit("x")), F.lit("\n▶ 位置："), none("location"), F.lit("\n▶ 代码特征："), "feature", F.lit("\n   more\n▶ 攻击向量："), none("vector"), F.lit("\n▶ 潜在影响："), none("impact"), F.lit("\n\nand on\n▶ 修复建议："), none("fix"))
    return reports.legacy(f.select("finding_id", section.alias("section")), "finding_id")


@query(S.FINDINGS + "select finding_id, finding_id % 5 = 0 as passes from f")
def pass_filter(s, d):
    f = table(s, d, "findings").dropDuplicates(["finding_id"])
    body = F.when(F.col("finding_id") % 5 == 0, "<审计报告>\n<结论>\n审核通过\n</结论>\n</审计报告>").otherwise(F.concat(F.lit("<文件><漏洞>"), F.coalesce("type", F.lit("")), F.lit("</漏洞></文件>")))
    return f.select("finding_id", reports.passes_only(body).alias("passes"))


@query(S.FINDINGS + "select finding_id, case when coalesce(type, '') = '' and coalesce(location, '') = '' then '未命名风险' when coalesce(type, '') = '' then location when coalesce(location, '') = '' then type else type || '（' || location || '）' end as title from f")
def finding_title(s, d):
    f = table(s, d, "findings").dropDuplicates(["finding_id"])
    return f.select("finding_id", reports.title(F.col("type"), F.lit(""), F.col("location")).alias("title"))


@query(S.FINDINGS + f"select {S.SEVERITY} as severity, count(*) as findings from (select *, coalesce(type, '') || '（' || {S.LEVEL} || '）' as t from f) x group by 1")
def severity_map(s, d):
    f = _leveled(s, d)
    return f.groupBy(reports.severity(F.col("type")).alias("severity")).agg(F.count("*").alias("findings"))


def _leveled(s, d) -> DataFrame:
    f = table(s, d, "findings").dropDuplicates(["finding_id"])
    level = F.element_at(F.array(F.lit("高危"), F.lit("中危"), F.lit("低危"), F.lit("low")), (F.col("finding_id") % 4 + 1).cast("int"))
    return f.withColumn("type", F.concat(F.coalesce("type", F.lit("")), F.lit("（"), level, F.lit("）")))


@query(S.FINDINGS + f"""select section, count(*) as n_findings, min(case {S.SEVERITY} when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end) as min_rank
  from (select *, coalesce(type, '') || '（' || {S.LEVEL} || '）' as t from f) x where {S.SEVERITY} in ('high', 'low') group by section""")
def review_filter_sort(s, d):
    return reports.section_order(reports.reviewed(_leveled(s, d), ["high", "low"]), "section")


@query(S.FINDINGS + f"""select count(distinct section) as sections, count(*) as visible, (select count(*) from f) as total
  from (select *, coalesce(type, '') || '（' || {S.LEVEL} || '）' as t from f) x where {S.SEVERITY} in ('high', 'medium')""")
def review_counts(s, d):
    return reports.counts(_leveled(s, d), ["high", "medium"])


@query(S.FINDINGS + "select section, count(*) as total, count(*) filter (where fix is null) as failed, round(count(*) filter (where fix is null) / count(*), 6) as rate, count(*) filter (where fix is null) > 0 and count(*) filter (where fix is null) / count(*) >= 0.05 as incomplete from f group by section")
def run_summary(s, d):
    f = table(s, d, "findings").dropDuplicates(["finding_id"]).withColumn("ok", F.col("fix").isNotNull())
    return reports.run_summary(f, 0.05, ["section"])


@query()
def reviewer_stub(s, d):
    rows = _units(s, d).dropDuplicates(["unit_id"]).select("unit_id", F.col("source_code").alias("payload"))
    return reviewer.reviewed(rows, "unit_id", concurrency=4 * s.sparkContext.defaultParallelism, limit_tokens=2000)  # the stub asks nobody


# ---------------------------------------------------------------- prompts and views

@query("select file_id, list_sort(list_distinct(regexp_extract_all(lower(path), '\\.(?:py|js|ts|java|go|php|cpp|cs|c)\\b'))) as langs from (select distinct file_id, path from source_files) t")
def language_sniff(s, d):
    return _files(s, d).select("file_id", reviewer.languages_in(F.col("path")).alias("langs"))


@query(S.prompts(reviewer))
def prompt_rules(s, d):
    exts = table(s, d, "source_files").select(text.suffix(F.col("path")).alias("ext")).distinct()
    return exts.select("ext", reviewer.extraction_prompt(F.col("ext")).alias("prompt"), reviewer.audit_prompt(F.array("ext")).alias("audit"))


@query(S.GRAPH + "select id, name, path, source_name, target_name, start_line, end_line, descr from nodes")
def node_table(s, d):
    return _nodes(s, d).select("id", "name", "path", "source_name", "target_name", "start_line", "end_line", "descr")


@query(S.GRAPH + "select src, dst from edges")
def edge_table(s, d):
    return _edges(s, d).select("src", "dst")


@query(S.GRAPH + "select id from nodes where " + " or ".join(f"regexp_matches(lower(cast({c} as varchar)), 'exec|\\(badge\\)')" for c in ("id", "source_name", "target_name", "descr", "start_line", "end_line", "name", "path")))
def any_column_search(s, d):
    rows = _nodes(s, d).select("id", "source_name", "target_name", "descr", "start_line", "end_line", "name", "path")
    return graph.search_any_column(rows, r"exec|\(badge\)").select("id")


@query(S.GRAPH + "select id, case when source_name <> '' then source_name else id end as label, 'file: ' || name || chr(10) || 'path: ' || path || chr(10) || 'summary: ' || descr || chr(10) || 'lines: ' || start_line || '-' || end_line as title, case when name <> '' then name else 'default' end as grp, case when source_code <> '' then 14 else 8 end as size from nodes")
def graph_view(s, d):
    return graph.view(_nodes(s, d))


@query(S.GRAPH + ", h as (select id from nodes order by node_ord, id limit 120) select src, dst from edges where src in (select id from h) and dst in (select id from h)")
def head_subgraph(s, d):
    return graph.head_subgraph(_nodes(s, d), _edges(s, d))


@query(S.GRAPH + """, und as (select src as a, dst as b from edges where src <> dst union select dst, src from edges where src <> dst), sel as (select id from nodes where source_name = 'eval'),
  hops as (select id as root, id, 0 as hop from sel union all select s.id, b, 1 from sel s join und on a = s.id union all select s.id, v.b, 2 from sel s join und u on u.a = s.id join und v on v.a = u.b)
select root, id, min(hop) as hop from hops group by root, id""")
def two_hop(s, d):
    n = _nodes(s, d)
    return graph.two_hop(_edges(s, d), n.where("source_name = 'eval'"))


@query(S.GRAPH + f"select id from nodes where source_name in ('eval', '{NO_DEPENDENCY}')")
def property_filter(s, d):
    return graph.with_property(_nodes(s, d), _edges(s, d), "source_name", ["eval", NO_DEPENDENCY])


@query(S.GRAPH + "select distinct id from (select src as id from edges where edge_ord % 100 = 7 union select dst from edges where edge_ord % 100 = 7) t")
def property_filter_edges(s, d):
    e = _edges(s, d).withColumn("bucket", (F.col("edge_ord") % 100).cast("string"))
    return graph.with_property(_nodes(s, d), e, "bucket", ["7"], by="edge")


@query("""with r as (select distinct repo, path from source_files), p as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, min(case when path like '%.json' then path end) as g, min(case when path like '%.xml' then path end) as x from r group by 1)
select dir, g as graph_path, x as report_path from p where g is not null""")
def result_discovery(s, d):
    rows = table(s, d, "source_files").select(F.regexp_replace(F.regexp_replace("path", r"\.json$", ".json.graphml"), r"\.xml$", ".xml_report.log").alias("path"), F.col("ingested_at").alias("modificationTime"))
    out = sources.discovered(rows)
    return out.select("dir", F.regexp_replace("graph_path", r"\.graphml$", "").alias("graph_path"), F.regexp_replace("report_path", r"_report\.log$", "").alias("report_path"))


# ---------------------------------------------------------------- sources and sinks that queries can reach

def _scratch(s: SparkSession) -> str:
    return f"{shared_folder(s).rstrip('/')}/{uuid.uuid4().hex}"


@query("select path, sha256(source_code) as sha from (select distinct file_id, path, source_code from source_files where source_code is not null) t")
def zip_ingest(s, d):
    def zipped(it):
        for pdf in it:
            out = []
            for path, code in zip(pdf.path, pdf.source_code):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr(path.lstrip("/"), code)
                out.append((path, raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    archives = _files(s, d).where("source_code is not null").select("path", "source_code").mapInPandas(zipped, "path string, content binary")
    return sources.from_zips(archives).select(F.col("archive").alias("path"), F.sha2("content", 256).alias("sha"))


@query(S.GRAPH + "select id, source_name, target_name, descr, start_line, end_line, name, path, md5(source_code) as code_md5 from nodes")
def graphml_nodes(s, d):
    folder = _scratch(s)
    sources.write_graphml(_nodes(s, d), _edges(s, d), folder)
    n, _ = sources.read_graphml(s, folder)
    return n.select("id", "source_name", "target_name", "descr", "start_line", "end_line", "name", "path", F.md5("source_code").alias("code_md5"))


@query(S.GRAPH + "select src, dst from edges")
def graphml_edges(s, d):
    folder = _scratch(s)
    sources.write_graphml(_nodes(s, d), _edges(s, d), folder)
    return sources.read_graphml(s, folder)[1]


@query(S.GRAPH + "select src, dst, edge_ord from edges")
def graph_memo(s, d):
    folder = sources.memo_path(_scratch(s), "graph", DEFAULTS)
    sources.graph_memo(s, folder, lambda: (_nodes(s, d), _edges(s, d)))
    return sources.graph_memo(s, folder, lambda: (_ for _ in ()).throw(ValueError("built twice")))[1].select("src", "dst", "edge_ord")


@query("""with r as (select distinct repo, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from source_files), f as (select repo, min(dir) as first_dir, max(dir) as last_dir from r group by repo)
select first_dir as dir from f union select last_dir from f""")
def latest_first(s, d):
    rows = table(s, d, "source_files").select("repo", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).distinct().groupBy("repo").agg(F.min("dir").alias("a"), F.max("dir").alias("b"))
    return sources.with_latest(rows.select(F.col("a").alias("dir")).distinct(), rows.select(F.col("b").alias("dir")).distinct())


@query(S.FINDINGS + """, t as (select section, count(*) as total, count(*) filter (where fix is null) as failed from f group by section)
select section, '<审计报告>' || chr(10) || '<结论>审计不完整</结论>' || chr(10) || '<统计>' || chr(10) || '总任务数: ' || total || chr(10) || '失败任务数: ' || failed || chr(10) || '失败率: ' || printf('%.2f', 100.0 * failed / total) || '%' || chr(10) || '阈值: 30.00%' || chr(10) || '</统计>' || chr(10) || '</审计报告>' as report from t""")
def incomplete_reports(s, d):
    f = table(s, d, "findings").dropDuplicates(["finding_id"]).groupBy("section").agg(F.count("*").alias("total"), F.count_if(F.col("fix").isNull()).alias("failed"))
    return f.select("section", reports.incomplete_report(F.col("total"), F.col("failed"), 0.3).alias("report"))


@query(S.FINDINGS + f"""select section, finding_id, row_number() over (partition by section order by case {S.SEVERITY} when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end, finding_id) as place
  from (select *, coalesce(type, '') || '（' || {S.LEVEL} || '）' as t from f) x where {S.SEVERITY} in ('high', 'low')""")
def review_findings_order(s, d):
    return reports.finding_order(reports.reviewed(_leveled(s, d), ["high", "low"]), "section", "finding_id").select("section", "finding_id", F.col("place").cast("long").alias("place"))


@query("select doc_id, md5(case when length(text) > 4000 then substr(text, 1, 4000) || chr(10) || '...' else text end) as md5 from (select distinct doc_id, text from documents where text is not null) t")
def raw_truncation(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.md5(text.truncated(F.col("text"))).alias("md5"))


@query(S.chunk_budget(reviewer, DEFAULTS))
def chunk_budget(s, d):
    exts = s.createDataFrame([(e,) for e in (*DEFAULTS.source_extensions, *DEFAULTS.config_extensions)], "ext string")
    prompts = exts.select(reviewer.extraction_prompt(F.col("ext")).alias("prompt"))
    return text.chunk_tokens(prompts, text.input_limit(DEFAULTS.max_input_tokens, None), DEFAULTS.overhead_tokens, DEFAULTS.legacy_chunk_tokens)


@query(S.flattened(chunks.BOUNDARIES, 100))
def flatten_chunks(s, d):
    rows = sources.flattened(_files(s, d), 100)
    return rows.select("file_id", "start_line", F.md5("source_code").alias("md5"))


@query()
def dispatch_units(s, d):
    review = lambda left: left.select("file_id", F.concat_ws(units.SEP, F.coalesce("name", F.lit("file")), F.lit(NO_DEPENDENCY), F.lit("no unit found"), F.lit("1-1")).alias("output"))  # noqa: E731 - stands for the model
    return units.all_units(_files(s, d).where("source_code is not null"), review)


@query("select t.day, repo, count(*) as files from (select date_trunc('day', scanned_at) as day, repo from source_files where scanned_at is not null) t group by 1, 2")
def arrivals_by_day(s, d):
    from ..streaming import ingest

    rows = ingest.arrivals(table(s, d, "source_files"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "repo", "files")


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return node_priority_topk(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
