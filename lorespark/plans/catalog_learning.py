"""Registered queries: learning and grading, over the order tables.

Regions are schools, nations degrees, customers courses and orders lessons;
a supplier is a learner whose line items record progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lorespark.functions import text as tx
from lorespark.operators import chunk_tables as ct
from lorespark.operators import learning as le
from lorespark.operators import quality as qa
from lorespark.plans.registry import Tables, query


def _day(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd")


def progress(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("learner"), F.col("l_orderkey").alias("lesson")).agg(
        F.bool_or(F.col("l_linestatus") == "F").alias("completed"),
        F.sum("l_quantity").cast("bigint").alias("seconds"), F.max("l_shipdate").alias("accessed"))


def lessons(t: Tables) -> DataFrame:
    courses = t.customer.select(F.col("c_custkey").alias("course"), F.col("c_nationkey").alias("path"))
    return t.orders.select(F.col("o_orderkey").alias("lesson"), F.col("o_custkey").alias("course")).join(courses, "course")


SQL_PROGRESS = """
pr AS (SELECT l_suppkey AS learner, l_orderkey AS lesson, bool_or(l_linestatus = 'F') AS completed,
  sum(l_quantity)::BIGINT AS seconds, max(l_shipdate) AS accessed FROM lineitem GROUP BY ALL),
ls AS (SELECT o_orderkey AS lesson, o_custkey AS course, c_nationkey AS path FROM orders JOIN customer ON c_custkey = o_custkey),
pc AS (SELECT learner, course, count(*) FILTER (completed) AS completed, sum(seconds) AS seconds, max(accessed) AS last_access
  FROM pr JOIN ls ON ls.lesson = pr.lesson GROUP BY ALL),
tc AS (SELECT course, count(*) AS total FROM ls GROUP BY ALL),
cp AS (SELECT learner, pc.course, total, completed, seconds, last_access, round_even(completed * 100.0 / total, 2)::DOUBLE AS percent
  FROM pc JOIN tc ON tc.course = pc.course)"""


def course_progress(t: Tables) -> DataFrame:
    done, les = progress(t), lessons(t)
    enrolled = done.join(les, "lesson").select("learner", "course").distinct()
    return le.progress_by_group(enrolled, les, done, "course")


def path_progress(t: Tables) -> DataFrame:
    done, les = progress(t), lessons(t)
    enrolled = done.join(les, "lesson").select("learner", "path").distinct()
    return le.progress_by_group(enrolled, les, done, "path")


@query("j1_published_catalog", """
WITH f AS (SELECT r_name AS school, n_name AS degree, c_name AS course, o_orderkey AS lesson_id FROM region JOIN nation ON n_regionkey = r_regionkey
  JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
  WHERE r_regionkey <> 0 AND o_orderstatus <> 'P' AND contains(lower(c_name), '1'))
SELECT *, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY school, degree, course, lesson_id LIMIT 100 OFFSET 100""")
def j1(t: Tables):
    schools = t.region.select(F.col("r_regionkey").alias("school_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") != 0).alias("open"))
    degrees = t.nation.select(F.col("n_nationkey").alias("degree_id"), F.col("n_regionkey").alias("school_id"),
                              F.col("n_name").alias("name"), F.lit(True).alias("open"))
    courses = t.customer.select(F.col("c_custkey").alias("course_id"), F.col("c_nationkey").alias("degree_id"),
                                F.col("c_name").alias("name"), F.contains(F.lower("c_name"), F.lit("1")).alias("open"))
    rows = t.orders.select(F.col("o_orderkey").alias("lesson_id"), F.col("o_custkey").alias("course_id"), (F.col("o_orderstatus") != "P").alias("open"))
    found = le.published_catalog(schools, degrees, courses, rows).select("school", "degree", "course", "lesson_id")
    return ct.listing(found, "school", ["degree", "course", "lesson_id"], offset=100, limit=100)


@query("j2_ordered_lessons", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT - 1 AS position FROM orders""")
def j2(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    out = le.ordered_children(rows, "o_custkey", ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"))
    return out.select("o_custkey", "o_orderkey", F.col("position").cast("bigint").alias("position"))


@query("j2_append_positions", """
SELECT c_custkey AS o_custkey, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0)::BIGINT AS next_position FROM customer""")
def j2_append(t: Tables):
    placed = j2(t)
    parents = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return le.append_positions(placed, parents, "o_custkey", "position")


@query("j3_course_progress", f"""
WITH {SQL_PROGRESS} SELECT learner, course, total::BIGINT AS total, completed::BIGINT AS completed, seconds::BIGINT AS seconds,
  strftime(last_access, '%Y-%m-%d') AS last_access, percent FROM cp""")
def j3(t: Tables):
    return course_progress(t).withColumn("last_access", _day("last_access"))


@query("j4_enrollment_rollup", f"""
WITH {SQL_PROGRESS}, p AS (SELECT *, CASE WHEN course % 3 = 0 THEN 'completed' ELSE 'in_progress' END AS prior,
  CASE WHEN course % 3 = 0 THEN '2020-01-01' END AS prior_done FROM cp)
SELECT learner, course, CASE WHEN completed = total THEN 'completed' WHEN prior = 'completed' THEN 'in_progress' ELSE prior END AS status,
  CASE WHEN completed = total THEN coalesce(prior_done, '2024-06-01') WHEN prior <> 'completed' THEN prior_done END AS completed_at, percent FROM p""")
def j4(t: Tables):
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    done = course_progress(t)
    is_done = F.col("course") % 3 == 0
    old = F.when(is_done, F.lit("2020-01-01").cast("timestamp_ntz"))
    prior = done.select("learner", "course", F.when(is_done, "completed").otherwise("in_progress").alias("status"),
                        old.alias("started_at"), old.alias("completed_at"), old.alias("last_accessed_at"))
    out = le.roll_up_enrollments(done, prior, "course", now)
    return out.select("learner", "course", "status", _day("completed_at").alias("completed_at"), "percent")


def assessment_attempts(t: Tables) -> DataFrame:
    score = F.col("l_discount") * 1000
    return t.lineitem.select(
        F.col("l_suppkey").alias("learner"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("submitted_at"),
        (score >= 50).alias("passed"), F.when(F.col("l_returnflag") != "N", score).alias("score_percent"))


@query("j5_dashboards", f"""
WITH {SQL_PROGRESS}, pp AS (SELECT learner, path, count(*) FILTER (completed) AS completed FROM pr JOIN ls ON ls.lesson = pr.lesson GROUP BY ALL),
tp AS (SELECT path, count(*) AS total FROM ls GROUP BY ALL),
al AS (SELECT learner, percent, completed = total AS fin, 1 AS c FROM cp
  UNION ALL SELECT learner, round_even(completed * 100.0 / total, 2)::DOUBLE, completed = total, 0 FROM pp JOIN tp ON tp.path = pp.path),
e AS (SELECT learner, round_even(avg(percent), 2)::DOUBLE AS overall_percent, sum(c)::BIGINT AS courses, sum(1 - c)::BIGINT AS paths,
  count(*) FILTER (fin AND c = 1)::BIGINT AS completed_courses, count(*) FILTER (fin AND c = 0)::BIGINT AS completed_paths FROM al GROUP BY learner),
l AS (SELECT learner, count(*) FILTER (completed)::BIGINT AS completed_lessons, sum(seconds)::BIGINT AS seconds FROM pr GROUP BY learner),
a AS (SELECT l_suppkey AS learner, count(*)::BIGINT AS attempts_started, count(*) FILTER (l_returnflag <> 'N')::BIGINT AS attempts_submitted,
  count(*) FILTER (l_discount * 1000 >= 50)::BIGINT AS attempts_passed,
  round_even(avg(l_discount * 1000) FILTER (l_returnflag <> 'N'), 2)::DOUBLE AS average_score FROM lineitem GROUP BY 1)
SELECT e.*, completed_lessons, l.seconds, attempts_started, attempts_submitted, attempts_passed, average_score
FROM e JOIN l ON l.learner = e.learner JOIN a ON a.learner = e.learner""")
def j5(t: Tables):
    return le.dashboards(course_progress(t), path_progress(t), progress(t), assessment_attempts(t))


@query("j6_recent_activity", """
WITH i AS (SELECT user_id AS learner, 'lesson_completed' AS activity, ts, event_id FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, CASE event_type WHEN 'click' THEN 'assessment_submitted' ELSE 'assessment_started' END, ts, event_id
  FROM events WHERE event_type IN ('click', 'view')),
r AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY ts DESC, event_id DESC) AS place FROM i)
SELECT learner, activity, event_id AS item_id, place::BIGINT AS place FROM r WHERE place <= 10""")
def j6(t: Tables):
    def items(rows, activity):
        return rows.select(F.col("user_id").alias("learner"), activity.alias("activity"),
                           F.col("ts").alias("occurred_at"), F.col("event_id").alias("item_id"))

    done = items(t.events.filter("event_type = 'purchase'"), F.lit("lesson_completed"))
    kind = F.when(F.col("event_type") == "click", "assessment_submitted").otherwise("assessment_started")
    tried = items(t.events.filter("event_type IN ('click', 'view')"), kind)
    out = le.recent_activity(done, tried, 10)
    return out.select("learner", "activity", "item_id", F.col("place").cast("bigint").alias("place"))


def questions(t: Tables) -> DataFrame:
    """Lines of an order as the questions of one attempt; the seventh line is unanswered."""
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    kind = F.when(F.col("l_returnflag") == "N", "short_answer").otherwise("multiple_choice")
    return t.lineitem.select(
        F.col("l_orderkey").alias("attempt"), F.row_number().over(order).alias("question"), kind.alias("type"),
        F.col("l_quantity").alias("points"), (F.col("l_linenumber") != 7).alias("answered"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("option"), "l_shipdate", "l_discount")


def _awarded(rows: DataFrame) -> DataFrame:
    got = F.when(F.col("option") == 1, F.col("points")).otherwise(0.0)
    return rows.withColumn("awarded", F.when(F.col("answered") & (F.col("type") != "short_answer"), got))


SQL_QUESTIONS = """
q AS (SELECT l_orderkey AS attempt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS question,
  CASE WHEN l_returnflag = 'N' THEN 'short_answer' ELSE 'multiple_choice' END AS type, l_quantity AS points, l_linenumber <> 7 AS answered,
  l_linestatus = 'F' AS right_option, l_shipdate, l_discount FROM lineitem)"""


@query("j7_automatic_grading", f"""
WITH {SQL_QUESTIONS}, g AS (SELECT attempt, sum(CASE WHEN type <> 'short_answer' AND answered AND right_option THEN points ELSE 0 END) AS e, sum(points) AS p,
  bool_and(type <> 'short_answer' AND answered) AS complete, bool_or(type = 'short_answer') AS manual FROM q GROUP BY attempt)
SELECT attempt, e::DOUBLE AS points_earned, p::DOUBLE AS points_possible, round_even((e * 100.0 / p)::DOUBLE, 2)::DOUBLE AS score,
  CASE WHEN complete THEN round_even((e * 100.0 / p)::DOUBLE, 2) >= 70 END AS passed,
  CASE WHEN complete THEN 'final' WHEN manual THEN 'manual_grading_required' ELSE 'pending' END AS grading_status FROM g""")
def j7(t: Tables):
    rows = questions(t)
    answers = rows.filter("answered").select("attempt", "question", "option")
    choices = rows.filter("type <> 'short_answer'").select(
        "attempt", "question", F.explode(F.array(F.lit(1), F.lit(2))).alias("option"))
    choices = choices.withColumn("is_correct", F.col("option") == 1)
    return le.grade_automatically(answers, rows.select("attempt", "question", "type", "points"), choices)


@query("j8_attempt_numbers", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)::BIGINT AS attempt_number,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) <= 2 AS allowed FROM orders""")
def j8(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    out = le.number_attempts(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"],
                             F.date_trunc("month", "o_orderdate"), 2)
    return out.select("o_custkey", "o_orderkey", F.col("attempt_number").cast("bigint").alias("attempt_number"), "allowed")


def grades(t: Tables) -> DataFrame:
    """One or two manual grades for most short answers."""
    rows = questions(t).filter("type = 'short_answer' AND answered AND l_discount > 0.01")
    again = F.when(F.col("l_discount") > 0.05, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("attempt", "question", "l_shipdate", "points", F.explode(again).alias("grade_id"))
    return rows.select("attempt", "question", "grade_id", F.col("l_shipdate").alias("created_at"),
                       (F.col("points") / F.col("grade_id")).alias("points"))


SQL_GRADES = SQL_QUESTIONS + """,
gr AS (SELECT attempt, question, l_shipdate AS created_at, unnest(CASE WHEN l_discount > 0.05 THEN [1, 2] ELSE [1] END) AS grade_id, points AS pts
  FROM q WHERE type = 'short_answer' AND answered AND l_discount > 0.01),
grades AS (SELECT attempt, question, grade_id, created_at, pts / grade_id AS points FROM gr),
lg AS (SELECT attempt, question, arg_max(points, (created_at, grade_id)) AS graded FROM grades GROUP BY ALL)"""


@query("j9_recalculated_scores", f"""
WITH {SQL_GRADES}, x AS (SELECT q.attempt, q.points, CASE WHEN type = 'short_answer' THEN graded WHEN answered THEN CASE WHEN right_option THEN q.points ELSE 0 END END AS val
  FROM q LEFT JOIN lg ON lg.attempt = q.attempt AND lg.question = q.question),
g AS (SELECT attempt, coalesce(sum(val), 0)::DOUBLE AS e, sum(points)::DOUBLE AS p, bool_and(val IS NOT NULL) AS complete FROM x GROUP BY attempt)
SELECT attempt, round_even(e, 4)::DOUBLE AS points_earned, p AS points_possible, round_even(e * 100.0 / p, 2)::DOUBLE AS score,
  CASE WHEN complete THEN round_even(e * 100.0 / p, 2) >= 70 END AS passed,
  CASE WHEN complete THEN 'graded' ELSE 'manual_grading_required' END AS grading_status FROM g""")
def j9(t: Tables):
    answers = _awarded(questions(t)).select("attempt", "question", "type", "points", "awarded")
    return le.recalculate(answers, grades(t))


@query("j9_grade_history", f"""
WITH {SQL_GRADES} SELECT attempt, question::BIGINT AS question, grade_id::BIGINT AS grade_id, points,
  lag(points) OVER w AS previous_points, CASE WHEN lag(points) OVER w IS NULL THEN 'manual_grade_created' ELSE 'grade_changed' END AS event_type
FROM grades WINDOW w AS (PARTITION BY attempt, question ORDER BY created_at, grade_id)""")
def j9_history(t: Tables):
    out = le.grade_history(grades(t), F.date_trunc("month", "created_at"))
    return out.select("attempt", F.col("question").cast("bigint").alias("question"),
                      F.col("grade_id").cast("bigint").alias("grade_id"), "points", "previous_points", "event_type")


@query("j10_grading_queue", f"""
WITH {SQL_GRADES}, u AS (SELECT DISTINCT attempt FROM q WHERE type = 'short_answer' AND (attempt, question) NOT IN (SELECT (attempt, question) FROM lg)),
f AS (SELECT o_orderkey AS attempt, o_custkey AS course, o_orderdate FROM orders JOIN u ON u.attempt = o_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE o_orderstatus <> 'P' AND c_nationkey < 12)
SELECT attempt, course, strftime(o_orderdate, '%Y-%m-%d') AS submitted_at, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY o_orderdate, attempt LIMIT 100""")
def j10(t: Tables):
    attempts = t.orders.select(F.col("o_orderkey").alias("attempt"), F.col("o_custkey").alias("course"),
                               F.col("o_orderdate").alias("submitted_at"), (F.col("o_orderstatus") != "P").alias("submitted"))
    waiting = le.needs_grading(attempts, questions(t), grades(t))
    scope = t.customer.filter("c_nationkey < 12").select(F.col("c_custkey").alias("course"))
    found = qa.scoped(waiting, scope, "course").select("attempt", "course", "submitted_at")
    return ct.listing(found, "submitted_at", "attempt", limit=100).withColumn("submitted_at", _day("submitted_at"))


@query("j11_assessment_course", """
WITH a AS (SELECT o_orderkey AS assessment, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 10 = 1 THEN o_custkey % 25 END AS course_id,
  CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS module_id, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey END AS lesson_id, o_custkey FROM orders)
SELECT assessment, coalesce(course_id, c_nationkey)::BIGINT AS course,
  (course_id IS NOT NULL)::INT + (module_id IS NOT NULL)::INT + (lesson_id IS NOT NULL)::INT = 1 AS owners_ok
FROM a JOIN customer ON c_custkey = o_custkey""")
def j11(t: Tables):
    k = F.col("o_orderkey")
    assessments = t.orders.select(
        k.alias("assessment"), F.when((k % 3 == 0) | (k % 10 == 1), F.col("o_custkey") % 25).alias("course_id"),
        F.when(k % 3 == 1, F.col("o_custkey")).alias("module_id"), F.when(k % 3 == 2, k).alias("lesson_id"))
    modules = t.customer.select(F.col("c_custkey").alias("module"), F.col("c_nationkey").cast("bigint").alias("course"))
    rows = t.orders.select(k.alias("lesson"), F.col("o_custkey").alias("module"))
    return le.assessment_courses(assessments, modules, rows)


@query("j12_audit_search", """
WITH f AS (SELECT event_id, user_id, event_type, ts FROM events WHERE event_type IN ('purchase', 'error') AND user_id % 10 = 3
  AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')
SELECT event_id, user_id, event_type, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY ts DESC, event_id DESC LIMIT 50""")
def j12(t: Tables):
    found = t.events.filter(
        "event_type IN ('purchase', 'error') AND user_id % 10 = 3 "
        "AND ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    out = ct.listing(found.select("event_id", "user_id", "event_type", "ts"), "ts", "event_id", descending=True, limit=50)
    return out.drop("ts")


def lesson_events(t: Tables) -> DataFrame:
    """events as lesson activity: ten lessons per user."""
    k = F.get_json_object("props", "$.k").cast("double")
    kind = (
        F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "access")
        .when(F.col("event_type") == "click", "time").when(F.col("event_type") == "purchase", "update")
        .when(k % 3 == 0, "reset").otherwise("complete"))
    amount = F.when(F.col("event_type") == "click", F.floor("value")).when(F.col("event_type") == "purchase", F.least(k + 30, F.lit(100.0)))
    return t.events.select(F.col("user_id").alias("learner"), (F.col("event_id") % 10).alias("lesson"), "ts", "event_id",
                           kind.alias("kind"), amount.cast("double").alias("amount"))


SQL_LESSON_EVENTS = """
le0 AS (SELECT user_id AS learner, event_id % 10 AS lesson, ts, event_id, (props->>'$.k')::DOUBLE AS k, event_type, value FROM events),
le AS (SELECT learner, lesson, ts, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'access' WHEN 'click' THEN 'time'
    WHEN 'purchase' THEN CASE WHEN k + 30 >= 100 THEN 'complete' ELSE 'update' END
    ELSE CASE WHEN k % 3 = 0 THEN 'reset' ELSE 'complete' END END AS kind,
  CASE event_type WHEN 'click' THEN floor(value) WHEN 'purchase' THEN least(k + 30, 100) END AS amount FROM le0),
ord AS (SELECT *, row_number() OVER (PARTITION BY learner, lesson ORDER BY ts, event_id) AS i FROM le),
st AS (SELECT learner, lesson, i, 'not_started' AS status, 0.0::DOUBLE AS percent, NULL::TIMESTAMP AS started, NULL::TIMESTAMP AS done, 0.0::DOUBLE AS secs,
    NULL::TIMESTAMP AS acc FROM (SELECT DISTINCT learner, lesson, 0 AS i FROM ord)
  UNION ALL SELECT s.learner, s.lesson, o.i,
    CASE WHEN kind = 'reset' THEN 'not_started' WHEN kind = 'complete' THEN 'completed'
      WHEN kind IN ('start', 'update') AND status = 'not_started' THEN 'in_progress' ELSE status END,
    CASE WHEN kind = 'reset' THEN 0 WHEN kind = 'complete' THEN 100 WHEN kind = 'update' AND status <> 'completed' THEN amount ELSE percent END,
    CASE WHEN kind = 'reset' THEN NULL WHEN kind = 'complete' AND status <> 'completed' THEN coalesce(started, ts)
      WHEN kind IN ('start', 'update') AND status = 'not_started' THEN ts ELSE started END,
    CASE WHEN kind = 'reset' THEN NULL WHEN kind = 'complete' AND status <> 'completed' THEN ts ELSE done END,
    secs + CASE WHEN kind = 'time' THEN amount ELSE 0 END,
    CASE WHEN kind IN ('complete', 'update') AND status = 'completed' THEN acc ELSE ts END
  FROM st s JOIN ord o ON o.learner = s.learner AND o.lesson = s.lesson AND o.i = s.i + 1)"""


@query("j14_lesson_progress", f"""
WITH RECURSIVE {SQL_LESSON_EVENTS}
SELECT learner, lesson, arg_max(status, i) AS status, arg_max(percent, i) AS percent, arg_max(secs, i) AS seconds,
  strftime(arg_max({{'x': started}}, i).x, '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(arg_max({{'x': done}}, i).x, '%Y-%m-%d %H:%M:%S.%f') AS completed_at,
  strftime(arg_max({{'x': acc}}, i).x, '%Y-%m-%d %H:%M:%S.%f') AS last_accessed FROM st GROUP BY learner, lesson""")
def j14(t: Tables):
    out = le.lesson_progress(lesson_events(t))
    stamp = lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("learner", "lesson", "status", "percent", "seconds", stamp("started_at"), stamp("completed_at"), stamp("last_accessed"))


@query("j14_completion_log", f"""
WITH RECURSIVE {SQL_LESSON_EVENTS}
SELECT o.learner, o.lesson, o.event_id FROM ord o JOIN st s ON s.learner = o.learner AND s.lesson = o.lesson AND s.i = o.i - 1
WHERE kind = 'complete' AND status <> 'completed'""")
def j14_log(t: Tables):
    return le.completion_log(lesson_events(t)).select("learner", "lesson", "event_id")


def review_actions(t: Tables) -> DataFrame:
    action = (
        F.when(F.col("event_type").isin("signup", "view"), "request").when(F.col("event_type") == "click", "approve")
        .when(F.col("event_type") == "purchase", "changes").otherwise("regrade"))
    return t.events.select(F.col("user_id").alias("attempt"), "ts", "event_id", action.alias("action"))


@query("j15_review_states", """
WITH RECURSIVE a AS (SELECT user_id AS attempt, CASE event_type WHEN 'signup' THEN 'request' WHEN 'view' THEN 'request' WHEN 'click' THEN 'approve'
    WHEN 'purchase' THEN 'changes' ELSE 'regrade' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT attempt, 0 AS i, 'none' AS status, 0 AS rejected FROM a
  UNION ALL SELECT s.attempt, a.i, CASE WHEN ok THEN CASE action WHEN 'request' THEN 'pending' WHEN 'approve' THEN 'approved'
      WHEN 'changes' THEN 'changes_requested' ELSE 'regraded' END ELSE status END, rejected + CASE WHEN ok THEN 0 ELSE 1 END
  FROM s JOIN a ON a.attempt = s.attempt AND a.i = s.i + 1,
    LATERAL (SELECT CASE WHEN action = 'request' THEN status <> 'pending' WHEN action = 'approve' THEN status = 'pending' AND s.attempt % 4 <> 0
      ELSE status = 'pending' END AS ok))
SELECT attempt, arg_max(status, i) AS review_status, max(rejected)::BIGINT AS rejected FROM s GROUP BY attempt""")
def j15(t: Tables):
    actions = review_actions(t)
    scored = actions.filter("attempt % 4 <> 0").select("attempt")
    return le.review_states(actions, scored)


@query("j15_regrade_problems", f"""
WITH {SQL_QUESTIONS}, sub AS (SELECT attempt, question + CASE WHEN attempt % 50 = 7 THEN 1 ELSE 0 END AS question FROM q
    WHERE type = 'short_answer' AND NOT (attempt % 40 = 3 AND question = 1)
  UNION ALL SELECT attempt, question FROM q WHERE type = 'short_answer' AND attempt % 60 = 5),
x AS (SELECT attempt, question, max(w) AS w, sum(s) AS s FROM (SELECT attempt, question, 1 AS w, 0 AS s FROM q WHERE type = 'short_answer'
  UNION ALL SELECT attempt, question, 0, 1 FROM sub) GROUP BY ALL)
SELECT attempt, count(*) FILTER (w = 1 AND s = 0)::BIGINT AS missing, count(*) FILTER (w = 0 AND s > 0)::BIGINT AS "unknown",
  count(*) FILTER (s > 1)::BIGINT AS repeated FROM x GROUP BY attempt
HAVING count(*) FILTER ((w = 1 AND s = 0) OR (w = 0 AND s > 0) OR s > 1) > 0""")
def j15_regrade(t: Tables):
    rows = questions(t)
    short = rows.filter("type = 'short_answer'")
    moved = F.col("question") + F.when(F.col("attempt") % 50 == 7, 1).otherwise(0)
    given = short.filter("NOT (attempt % 40 = 3 AND question = 1)").select("attempt", moved.alias("question"))
    twice = short.filter("attempt % 60 = 5").select("attempt", "question")
    return le.regrade_problems(given.unionByName(twice), rows)


@query("j16_definition_problems", """
WITH p AS (SELECT p_partkey AS question, CASE p_size % 3 WHEN 0 THEN 'short_answer' WHEN 1 THEN 'true_false' ELSE 'multiple_choice' END AS type,
  CASE WHEN p_size = 50 THEN '' ELSE p_name END AS prompt, p_retailprice - 950 AS points, p_partkey % 4 AS n, CASE WHEN p_partkey % 4 > 0 AND p_size % 7 <> 0 THEN 1 ELSE 0 END AS r FROM part),
x AS (SELECT question, array_to_string(list_filter([CASE WHEN trim(prompt) = '' THEN 'prompt missing' END, CASE WHEN points < 0 THEN 'negative points' END,
  CASE WHEN type = 'short_answer' AND n > 0 THEN 'short answer with options' END, CASE WHEN type <> 'short_answer' AND n < 2 THEN 'fewer than two options' END,
  CASE WHEN type = 'true_false' AND n > 2 THEN 'true/false needs two options' END,
  CASE WHEN type <> 'short_answer' AND n >= 2 AND r <> 1 THEN 'not exactly one correct option' END], lambda x: x IS NOT NULL), '; ') AS problems FROM p)
SELECT * FROM x WHERE problems <> ''""")
def j16(t: Tables):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "short_answer").when(size % 3 == 1, "true_false").otherwise("multiple_choice")
    rows = t.part.select(F.col("p_partkey").alias("question"), kind.alias("type"),
                         F.when(size == 50, "").otherwise(F.col("p_name")).alias("prompt"), (F.col("p_retailprice") - 950).alias("points"))
    choices = t.part.filter("p_partkey % 4 > 0").select(
        F.col("p_partkey").alias("question"), "p_size", F.explode(F.sequence(F.lit(1), (F.col("p_partkey") % 4).cast("int"))).alias("o"))
    choices = choices.select("question", ((F.col("o") == 1) & (F.col("p_size") % 7 != 0)).alias("is_correct"))
    out = le.definition_problems(rows, choices)
    return out.withColumn("problems", F.array_join("problems", "; "))


@query("j17_identity_problems", """
WITH l AS (SELECT c_custkey, nullif(CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'u' || c_custkey % 1400 END, ' ') AS x,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '@mail' ELSE lower(c_mktsegment) || c_custkey // 2 || '@mail.invalid' END AS m FROM customer),
c AS (SELECT *, count(*) OVER (PARTITION BY x) AS nx, count(*) OVER (PARTITION BY m) AS nm FROM l),
p AS (SELECT c_custkey, array_to_string(list_filter([CASE WHEN x IS NULL AND m IS NULL THEN 'no identity' END, CASE WHEN m LIKE '@%' THEN 'email malformed' END,
  CASE WHEN x IS NOT NULL AND nx > 1 THEN 'external id repeated' END, CASE WHEN m IS NOT NULL AND nm > 1 THEN 'email repeated' END], lambda z: z IS NOT NULL), '; ') AS problems FROM c)
SELECT * FROM p WHERE problems <> ''""")
def j17(t: Tables):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    ext = F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("u"), text(k % 1400)))
    half = F.floor(k / 2).cast("string")
    mail = F.when(k % 5 == 0, None).when(k % 11 == 0, " @MAIL").otherwise(
        F.concat("c_mktsegment", half, F.lit("@mail.invalid ")))
    rows = t.customer.select("c_custkey", ext.alias("ext"), mail.alias("mail"), "c_name")
    out = le.identity_problems(rows, "c_custkey", "ext", "mail", "c_name")
    return out.withColumn("problems", F.array_join("problems", "; "))
