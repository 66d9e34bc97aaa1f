"""Review reports: splitting, structured and legacy parsing, titles, severities, filters, order, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The report format's separator, tags, labels and verdict texts.
SEPARATOR = "--------------------------------"
PASS = ("审计通过", "结构化审计通过结果", "审核通过")
INCOMPLETE = "审计不完整"
UNKNOWN_FILE, UNNAMED = "未知文件", "未命名风险"
LEGACY = {"■ 漏洞类型：": "type", "▶ 位置：": "location", "▶ 代码特征：": "feature", "▶ 攻击向量：": "vector", "▶ 潜在影响：": "impact", "▶ 修复建议：": "fix"}
TAGS = {"feature": "代码特征", "vector": "攻击向量", "impact": "潜在影响", "fix": "修复建议"}


def split_sections(df: DataFrame, column: str = "report") -> DataFrame:
    """df's other columns with section_no (from 1) and section; blank sections are dropped before numbering."""
    parts = F.filter(F.transform(F.split(F.col(column), SEPARATOR), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    return df.select(*[c for c in df.columns if c != column], F.posexplode(parts).alias("_p", "section")).withColumn("section_no", F.col("_p") + 1).drop("_p")


def tag(c: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(c, rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1), r"^\s+|\s+$", "")


def line_value(c: Column, name: str) -> Column:
    """The value behind a label at a line's start; an empty value takes the next line, as the format's readers do."""
    return F.regexp_replace(F.regexp_extract(c, rf"(?dm)^{name}\s*:\s*(.+)$", 1), r"^\s+|\s+$", "")


def title(kind: Column, verdict: Column, level: Column) -> Column:
    """'kind（verdict / level）' of the parts that are not empty."""
    parts = F.filter(F.array(kind, verdict, level), lambda c: F.coalesce(F.length(c), F.lit(0)) > 0)
    rest = F.array_join(F.slice(parts, 2, 2), " / ")
    return F.when(F.size(parts) == 0, F.lit(UNNAMED)).when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("（"), rest, F.lit("）")))


def severity(c: Column) -> Column:
    """'high', 'medium', 'low' or 'info' by what the title contains, in this order."""
    low = F.lower(c)
    return F.when(c.contains("高危") | low.contains("critical") | low.contains("high"), "high").when(c.contains("中危") | low.contains("medium"), "medium").when(c.contains("低危") | low.contains("low"), "low").otherwise("info")


def severity_rank(c: Column) -> Column:
    s = severity(c)
    return F.when(s == "high", 0).when(s == "medium", 1).when(s == "low", 2).otherwise(3)


def is_pass(c: Column) -> Column:
    return F.coalesce(F.trim(c).isin(*PASS), F.lit(False))


def is_incomplete(c: Column) -> Column:
    return F.coalesce(F.trim(c) == INCOMPLETE, F.lit(False))


def structured(sections: DataFrame) -> DataFrame:
    """sections' columns with file_path, finding_no (from 1), type, location, feature, vector, impact, fix; one row per finding."""
    keep = [c for c in sections.columns if c != "section"]
    files = sections.where(F.col("section").contains("<审计报告>")).select(*keep, F.posexplode(F.regexp_extract_all("section", F.lit(r"(?s)<文件>\s*(.*?)\s*</文件>"), F.lit(1))).alias("_n", "_f"))
    path = line_value(F.col("_f"), "路径")
    files = files.withColumn("_path", F.when(path == "", UNKNOWN_FILE).otherwise(path)).withColumn("_verdict", line_value(F.col("_f"), "结论"))
    found = files.select(*keep, "_n", "_path", "_verdict", F.posexplode_outer(F.regexp_extract_all("_f", F.lit(r"(?s)<漏洞>\s*(.*?)\s*</漏洞>"), F.lit(1))).alias("_k", "_v"))
    found = found.where(F.col("_v").isNotNull() | is_pass(F.col("_verdict")))
    v, empty = F.col("_v"), F.col("_v").isNull()
    location = line_value(v, "位置")
    return found.select(*keep, (F.col("_n") + 1).alias("file_no"), F.col("_path").alias("file_path"), (F.coalesce("_k", F.lit(0)) + 1).alias("finding_no"), F.when(empty, PASS[0]).otherwise(title(line_value(v, "类型"), line_value(v, "判定"), line_value(v, "等级"))).alias("type"), F.when(empty | (location == ""), "-").otherwise(location).alias("location"), *[F.when(empty, F.lit("")).otherwise(tag(v, t)).alias(c) for c, t in TAGS.items()])


def legacy(sections: DataFrame, key: str) -> DataFrame:
    """(key, file_path, finding_no, type, location, feature, vector, impact, fix) of sections in the older line format.

    The state machine over lines is a carry-forward: the last label seen so far decides where a line belongs.
    """
    lines = sections.select(key, F.posexplode(F.split("section", r"\r\n|\n|\r")).alias("n", "raw")).withColumn("line", F.trim("raw")).where(F.col("line") != "")
    field, value = F.lit(None).cast("string"), F.col("line")
    for mark, name in LEGACY.items():
        field = F.when(F.col("line").startswith(mark), F.lit(name)).otherwise(field)
        value = F.when(F.col("line").startswith(mark), F.trim(F.substring("line", len(mark) + 1, 1 << 20))).otherwise(value)
    lines = lines.withColumn("path", F.when(F.col("line").startswith("// "), F.trim(F.substring("line", 4, 1 << 20)))).withColumn("mark", field).withColumn("value", value)
    w = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("finding_no", F.sum((F.col("mark") == "type").cast("int")).over(w)).withColumn("field", F.last("mark", ignorenulls=True).over(w))
    paths = lines.groupBy(key).agg(F.max_by("path", F.when(F.col("path").isNotNull(), F.col("n"))).alias("file_path"))
    body = lines.where((F.col("finding_no") > 0) & F.col("path").isNull() & (F.col("mark").isNotNull() | ~F.col("line").startswith("<")) & (F.col("mark").isNotNull() | (F.col("field") != "type")))
    parts = body.groupBy(key, "finding_no", "field").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("vs"))
    wide = parts.withColumn("text", F.when(F.col("field") == "feature", F.array_join(F.filter(F.col("vs.value"), lambda c: c != ""), "\n")).otherwise(F.array_join(F.filter(F.col("vs.value"), lambda c: c != ""), " ")))
    cols = [F.coalesce(F.max(F.when(F.col("field") == c, F.col("text"))), F.lit("")).alias(c) for c in LEGACY.values()]
    return wide.groupBy(key, "finding_no").agg(*cols).join(paths, key).select(key, F.coalesce("file_path", F.lit(UNKNOWN_FILE)).alias("file_path"), "finding_no", *LEGACY.values())


def passes_only(c: Column) -> Column:
    """Whether a report says nothing but that all passed; an empty report does."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    verdicts = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<结论>\s*(.*?)\s*</结论>"), F.lit(1)), lambda c: F.trim(c))
    all_pass = (F.size(verdicts) > 0) & F.forall(verdicts, lambda v: v.isin(*PASS))
    return F.when(body == "", True).when(body.contains("<文件>") & body.contains("<漏洞>"), False).otherwise((body == "<审计通过>") | all_pass | body.isin(*PASS))


def is_visible(c: Column, levels: list[str], show_passed: bool) -> Column:
    return F.when(is_pass(c), F.lit(show_passed)).when(is_incomplete(c), True).otherwise(severity(c).isin(*levels))


def counts(findings: DataFrame, levels: list[str], show_passed: bool = False, section: str = "section") -> DataFrame:
    """(sections, visible, total): visible sections and findings, and all findings, in one aggregation."""
    seen = is_visible(F.coalesce("type", F.lit("")), levels, show_passed)
    return findings.agg(F.countDistinct(F.when(seen, F.col(section))).alias("sections"), F.count_if(seen).alias("visible"), F.count("*").alias("total"))


def reviewed(findings: DataFrame, levels: list[str], show_passed: bool = False) -> DataFrame:
    """Visible findings (key columns section, type, ...) with their severity: passes only if shown, incomplete always."""
    t = F.coalesce("type", F.lit(""))
    rows = findings.withColumn("severity", severity(t)).withColumn("severity_rank", severity_rank(t))
    return rows.where(is_visible(t, levels, show_passed))


def section_order(visible: DataFrame, key: str) -> DataFrame:
    """(key, n_findings, min_rank): sections by their worst finding that is no pass, 99 without one."""
    worst = F.min(F.when(~is_pass(F.col("type")), F.col("severity_rank")))
    return visible.groupBy(key).agg(F.count("*").alias("n_findings"), F.coalesce(worst, F.lit(99)).alias("min_rank")).orderBy("min_rank", key)


def finding_order(visible: DataFrame, key: str, ord: str) -> DataFrame:
    """visible with place: the order of findings inside a section, worst first, as they came among equals."""
    w = Window.partitionBy(key).orderBy("severity_rank", ord)
    return visible.withColumn("place", F.row_number().over(w))


def incomplete_report(total: Column, failed: Column, threshold: float) -> Column:
    rate = F.when(total > 0, failed / total).otherwise(0.0)
    return F.format_string("<审计报告>\n<结论>审计不完整</结论>\n<统计>\n总任务数: %d\n失败任务数: %d\n失败率: %.2f%%\n阈值: %.2f%%\n</统计>\n</审计报告>", total, failed, rate * 100, F.lit(threshold * 100.0))


def run_summary(results: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """(total, failed, rate, incomplete) of results with a boolean column ok; incomplete from the threshold on, if any failed."""
    t = min(1.0, max(0.0, threshold))
    rows = results.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed"))
    rate = F.when(F.col("total") > 0, F.col("failed") / F.col("total")).otherwise(0.0)
    return rows.withColumn("rate", F.round(rate, 6)).withColumn("incomplete", (F.col("failed") > 0) & (rate >= t))
