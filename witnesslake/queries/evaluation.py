"""Offline evaluation: reports, failures, totals, run comparison, annotation lint, quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from witnesslake.catalog import _obs, query
from witnesslake.operators import evaluation
from witnesslake.sources.views import table

# Subjects of frames (orders) are line items; words that Spark and SQL share.
_TRUTH = "case l_returnflag when 'A' then 'PRESENT' when 'N' then 'ABSENT' else 'NOT_VISIBLE' end"
_SAID = "case when l_suppkey % 11 = 0 then null when l_discount > 0.05 then 'PRESENT' when l_tax > 0.05 then 'NOT_VISIBLE' else 'ABSENT' end"
_QUALITY = "case l_suppkey % 9 when 0 then 'too_blurry' when 1 then 'rejected: too_small' when 2 then 'too_occluded' when 3 then 'degenerate' else '' end"
_SKIP = "case l_partkey % 8 when 0 then 'too_truncated' when 1 then 'too_small' else '' end"
_MATCHED = "(l_linenumber % 7 > 0 and l_orderkey % 10 > 0)"
_ROWS = f"select l_orderkey as frame_id, l_linenumber as subject_id, l_shipmode as attribute, {_TRUTH} as truth, {_SAID} as predicted, {_MATCHED} as matched, {_QUALITY} as quality, {_SKIP} as skip, l_partkey % 2 = 0 as model_used from lineitem".replace("l_shipmode", "l_linestatus")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = dict(frame_id="l_orderkey", subject_id="l_linenumber", attribute="l_linestatus", truth=_TRUTH, predicted=_SAID, matched=_MATCHED, quality=_QUALITY, skip=_SKIP, model_used="l_partkey % 2 = 0")
    return table(spark, sf_dir, "lineitem").select(*(F.expr(v).alias(k) for k, v in cols.items()))


@query(f"""with r as ({_ROWS}) select attribute, count(*) filter (matched) as matched, count(*) filter (matched and truth = predicted) as correct, round(count(*) filter (matched and truth = predicted) / nullif(count(*) filter (matched), 0), 9) as accuracy, round(count(*) filter (matched and predicted = 'NOT_VISIBLE') / nullif(count(*) filter (matched), 0), 9) as not_visible_rate,
    count(*) filter (matched and truth = 'NOT_VISIBLE' and predicted in ('PRESENT', 'ABSENT')) as unsupported_claims, count(*) filter (matched and predicted is null) as missing from r group by 1""")
def attribute_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attribute_reports(_subjects(spark, sf_dir))


@query(f"""with r as ({_ROWS}) select case when contains(quality || '|' || skip, 'too_blurry') then 'motion_blur' when contains(quality || '|' || skip, 'too_small') then 'low_resolution' when contains(quality || '|' || skip, 'too_occluded') then 'occlusion' when contains(quality || '|' || skip, 'too_truncated') then 'truncation'
    when contains(quality || '|' || skip, 'degenerate') then 'crop_failure' when truth = 'NOT_VISIBLE' and predicted <> 'NOT_VISIBLE' then 'unknown_handling_failure' when predicted = 'NOT_VISIBLE' then 'semantic_model_failure' when model_used then 'vlm_failure' else 'semantic_model_failure' end as category, count(*) as n
    from r where matched and truth <> predicted group by 1""")
def failures_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = _subjects(spark, sf_dir).where(F.col("matched") & (F.col("truth") != F.col("predicted")))
    name = evaluation.category(*(F.col(c) for c in ("truth", "predicted", "quality", "skip", "model_used")))
    return wrong.groupBy(name.alias("category")).agg(F.count("*").alias("n"))


@query(f"""with r as ({_ROWS}), f as (select o_orderkey, o_custkey % 5 as calls from orders), s as (select * from lineitem where l_suppkey % 17 = 0), a as (select count(*) as annotated, count(*) filter (matched) as matched, count(*) filter (not matched) as unmatched from r)
    select (select count(*) from f) as frames, annotated, matched, unmatched, (select count(*) from s) as spurious, round(matched / annotated, 9) as detection_recall, round((select sum(calls) from f) * 1000 / (select count(*) from f), 9) as calls_per_1000_frames, round((select sum(calls) from f) / matched, 9) as calls_per_person from a""")
def eval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("calls"))
    return evaluation.totals(_subjects(spark, sf_dir), frames, table(spark, sf_dir, "lineitem").where("l_suppkey % 17 = 0"))


@query("""with t as (select o_orderkey as frame_id, o_custkey % 4 as n_subjects from orders), p as (select o_orderkey as frame_id, o_custkey % 3 as n_predicted from orders where o_orderkey % 9 > 0)
    select frame_id, n_subjects, p.n_predicted, case when p.frame_id is null then n_subjects else greatest(n_subjects - p.n_predicted, 0) end as n_unmatched from t left join p using (frame_id)""")
def truth_prediction_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All truth frames; of a frame without prediction all subjects are unmatched."""
    o = table(spark, sf_dir, "orders")
    truth = o.select(F.col("o_orderkey").alias("frame_id"), (F.col("o_custkey") % 4).alias("n_subjects"))
    predicted = o.where("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("frame_id"), (F.col("o_custkey") % 3).alias("n_predicted"))
    return truth.join(predicted, "frame_id", "left").withColumn("n_unmatched", F.greatest(F.col("n_subjects") - F.coalesce("n_predicted", F.lit(0)), F.lit(0)))


@query(f"""with r as ({_ROWS}), m as (select attribute as run, 'matched' as metric, count(*) filter (matched)::double as value from r group by 1 union all select attribute, 'accuracy', round(count(*) filter (matched and truth = predicted) / count(*) filter (matched), 9) from r group by 1)
    select metric, max(value) filter (run = 'F') as "F", max(value) filter (run = 'O') as "O" from m group by 1""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two runs side by side."""
    r = evaluation.attribute_reports(_subjects(spark, sf_dir))
    long = r.select(F.col("attribute").alias("run"), F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("matched", "accuracy")))))
    return evaluation.compared(long, ["F", "O"])


@query(f"with r as ({_ROWS}) select attribute, truth as state, count(*) as n from r group by all")
def attribute_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).groupBy("attribute", F.col("truth").alias("state")).agg(F.count("*").alias("n"))


# Annotations: a frame is two orders' items at times, a person two rows of an item at times.
_PEOPLE = """select case when o_orderkey % 40 = 1 then o_orderkey - 1 else o_orderkey end as frame_id, o_orderkey as frame_row, case when o_custkey % 15 = 0 then 'model' else 'human_visual_inspection' end as source,
    case when l_suppkey % 20 = 0 then '' when l_linenumber % 4 = 3 then 'p1' else concat('p', l_linenumber) end as person_id, l_linenumber as person_row, case l_partkey % 4 when 0 then 'not_visible' when 1 then 'partially_visible' else 'visible' end as visibility,
    case when l_partkey % 6 = 0 then null when l_suppkey % 13 = 0 then 'shoes' else 'head' end as attribute, case l_returnflag when 'A' then 'PRESENT' when 'N' then 'ABSENT' else 'NOT_VISIBLE' end as state,
    case l_linenumber % 3 when 0 then 'observable' when 1 then 'partially_observable' else 'not_observable' end as observability, case when l_suppkey % 2 = 0 then 'behind a pillar' else '' end as note from lineitem join orders on l_orderkey = o_orderkey"""


@query(f"""with p as ({_PEOPLE}), f as (select distinct frame_id, frame_row, source from p), q as (select frame_id, frame_row, person_id, person_row, max(visibility) as visibility, count(attribute) > 0 as noted from p group by 1, 2, 3, 4),
    i as (select frame_id, '' as person_id, '' as attribute, 'duplicate_frame' as issue from (select *, row_number() over (partition by frame_id order by frame_row) as nth from f) where nth > 1 union all select frame_id, '', '', 'non_human_annotation' from f where source <> 'human_visual_inspection'
        union all select frame_id, person_id, '', 'missing_person_id' from q where person_id = '' union all select frame_id, person_id, '', 'duplicate_person' from (select *, row_number() over (partition by frame_id, frame_row, person_id order by person_row) as nth from q) where nth > 1
        union all select frame_id, person_id, attribute, 'unknown_attribute' from p where attribute = 'shoes' union all select frame_id, person_id, attribute, 'decided_state_without_observability' from p where attribute is not null and state in ('PRESENT', 'ABSENT') and observability = 'not_observable'
        union all select frame_id, person_id, attribute, 'unexplained_refusal' from p where attribute is not null and state = 'NOT_VISIBLE' and observability = 'observable' and note = '' union all select frame_id, person_id, '', 'ppe_on_invisible_person' from q where visibility = 'not_visible' and noted)
    select frame_id, person_id, attribute, issue, count(*) as n from i group by all""")
def annotation_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of all annotations."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    columns = _PEOPLE.removeprefix("select ").split(" from lineitem")[0]
    people = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_split(columns))
    return evaluation.lint(people, ["head"]).groupBy("frame_id", "person_id", "attribute", "issue").agg(F.count("*").alias("n"))


def _split(columns: str) -> list[str]:
    """A select list parted at its outer commas."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


_NOTE = "case l_linenumber % 6 when 0 then 'Head TURNED to the wall' when 1 then 'bent over the table' when 2 then 'cropped off' when 3 then 'a distant, ambiguous shape' when 4 then 'turned and out of frame' else 'no idea' end"
#: Words of annotators' notes and the causes they stand for, in the order asked: fixed values.
CAUSES = (("turned", "head_turned_away"), ("bent", "head_bent_down"), ("cropped off", "truncation"), ("out of frame", "truncation"), ("distant", "poor_view_angle"), ("ambiguous", "poor_view_angle"))


@query(f"select case l_linenumber % 6 when 0 then 'head_turned_away' when 1 then 'head_bent_down' when 2 then 'truncation' when 3 then 'poor_view_angle' when 4 then 'head_turned_away' else 'unknown' end as cause, count(*) as n from ({_ROWS.replace('from lineitem', ', l_linenumber from lineitem')}) where truth = 'NOT_VISIBLE' group by 1")
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.lower(F.expr(_NOTE))
    cause = F.coalesce(*(F.when(F.contains(note, F.lit(word)), name) for word, name in CAUSES), F.lit("unknown"))
    return table(spark, sf_dir, "lineitem").where(F.expr(_TRUTH) == "NOT_VISIBLE").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


_SEEN = ("l_quantity > 20", "l_quantity * (1 - l_discount) > 20")


@query(f"""with c as (select count(*) filter (t and p) as tp, count(*) filter (p and not t) as fp, count(*) filter (not t and not p) as tn, count(*) filter (t and not p) as fn from (select {_SEEN[0].replace('20', '23')} as t, {_SEEN[1]} as p from lineitem))
    select *, round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1, round(fp / nullif(fp + tn, 0), 9) as unsafe_acceptance from c""")
def pose_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observable heads by the annotator against those a pose model locates."""
    rows = table(spark, sf_dir, "lineitem").select(F.expr(_SEEN[0].replace("20", "23")).alias("t"), F.expr(_SEEN[1]).alias("p"))
    c = rows.agg(*(F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "t and p"), ("fp", "p and not t"), ("tn", "not t and not p"), ("fn", "t and not p"))))
    share = lambda a, b: F.round(F.expr(f"{a} / nullif({b}, 0)"), 9)
    return c.select("*", share("tp", "tp + fp").alias("precision"), share("tp", "tp + fn").alias("recall"), share("2 * tp", "2 * tp + fp + fn").alias("f1"), share("fp", "fp + tn").alias("unsafe_acceptance"))


_G = dict(scale="case when k % 23 = 0 then null else value end", truncation="(k % 11) / 10.0::double", occlusion="(k % 7) / 6.0::double", crowding="case when k % 2 = 0 then (k % 17) / 16.0::double end", blur="case when k % 5 > 0 then (k % 13) / 12.0::double end")
_GRADES = ", g as (select event_id, k, value, " + ", ".join(f"{v} as {c}" for c, v in _G.items()) + ", case k % 9 when 0 then 'under' when 1 then 'over' when 2 then null else 'good' end as exposure, case when k % 19 = 0 then 'insufficient' else 'good' end as overall from obs)"


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = {c: v.replace("::double", "D").replace("10.0D", "10D").replace("6.0D", "6D").replace("16.0D", "16D").replace("12.0D", "12D") for c, v in _G.items()}
    return _obs(spark, sf_dir).select("event_id", "k", "value", *(F.expr(v).alias(c) for c, v in exprs.items()), F.expr("case k % 9 when 0 then 'under' when 1 then 'over' when 2 then null else 'good' end").alias("exposure"), F.expr("case when k % 19 = 0 then 'insufficient' else 'good' end").alias("overall"))


@query(f"""{_GRADES} select event_id, case when scale <= 0 then 'no_area' when scale < 48 then 'too_small' when truncation > 0.5 then 'truncated' when occlusion > 0.7 or crowding > 0.9 then 'occluded' when blur > 0.85 then 'blurred' when exposure in ('under', 'over') then 'exposure' when overall = 'insufficient' and scale is null then 'too_small' when overall = 'insufficient' then 'no_area' else 'pass' end as reason from g""")
def quality_gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grades(spark, sf_dir)
    return g.select("event_id", evaluation.quality_reason(*(F.col(c) for c in ("scale", "truncation", "occlusion", "crowding", "blur", "exposure", "overall"))).alias("reason"))


@query(f"""{_GRADES} select event_id, case when value < 48 or truncation > 0.5 or occlusion > 0.7 or coalesce(blur, 0) > 0.85 then 'insufficient' when value < 96 or truncation > 0.25 or occlusion > 0.35 or coalesce(blur, 0) > 0.425 or coalesce(exposure, '') in ('under', 'over') then 'marginal' when blur < 0.2125 and exposure is not null then 'excellent' else 'good' end as level from g""")
def quality_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grades(spark, sf_dir)
    return g.select("event_id", evaluation.quality_level(*(F.col(c) for c in ("value", "truncation", "occlusion", "blur", "exposure"))).alias("level"))
