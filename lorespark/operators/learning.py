"""Learning progress, grading and curriculum analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorespark.functions.ordered import with_neighbour, with_running
from lorespark.sources.corpus import reasons


def percentage(part: Column, whole: Column) -> Column:
    """Percent rounded half-even to two places; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part * 100.0 / whole, 2))


def published_catalog(
    schools: DataFrame, degrees: DataFrame, courses: DataFrame, lessons: DataFrame
) -> DataFrame:
    """Lessons with their whole hierarchy, published levels only.

    Tables carry school_id/degree_id/course_id/lesson_id, their parents'
    ids, names and a boolean ``open``. Filters run before the joins; which
    sides are broadcast is left to their measured size.
    """
    s = schools.filter("open").select("school_id", F.col("name").alias("school"))
    d = degrees.filter("open").select("degree_id", "school_id", F.col("name").alias("degree"))
    c = courses.filter("open").select("course_id", "degree_id", F.col("name").alias("course"))
    les = lessons.filter("open").drop("open")
    return les.join(c, "course_id").join(d, "degree_id").join(s, "school_id")


def ordered_children(
    df: DataFrame, parent: str, order: Sequence[str], segment: Column
) -> DataFrame:
    """Add ``position`` (from 0) of each child inside its parent."""
    out = with_running(df, parent, list(order), segment, {"__n": F.lit(1)})
    return out.withColumn("position", F.col("__n") - 1).drop("__n")


def append_positions(placed: DataFrame, parents: DataFrame, parent: str, position: str) -> DataFrame:
    """(parent, next_position): where the next child of each parent goes."""
    last = placed.groupBy(parent).agg(F.max(position).alias("__m"))
    return parents.select(parent).distinct().join(last, parent, "left").select(
        parent, F.coalesce(F.col("__m") + 1, F.lit(0)).alias("next_position")
    )


def progress_by_group(
    enrolled: DataFrame, lessons: DataFrame, progress: DataFrame, group: str
) -> DataFrame:
    """(learner, group, total, completed, seconds, last_access, percent).

    ``enrolled`` (learner, group), ``lessons`` (lesson, group), ``progress``
    (learner, lesson, completed, seconds, accessed). Progress is summed per
    learner and group before it meets the enrolments.
    """
    totals = lessons.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    done = progress.join(lessons.select("lesson", group), "lesson").groupBy("learner", group).agg(
        F.count_if("completed").alias("completed"),
        F.sum("seconds").alias("seconds"),
        F.max("accessed").alias("last_access"),
    )
    rows = enrolled.join(totals, group, "left").join(done, ["learner", group], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "learner", group, zero("total").alias("total"), zero("completed").alias("completed"),
        zero("seconds").alias("seconds"), "last_access",
        percentage(zero("completed"), zero("total")).alias("percent"),
    )


def roll_up_enrollments(progress: DataFrame, prior: DataFrame, group: str, now: Column) -> DataFrame:
    """New enrolment state from progress and the prior status and dates."""
    rows = prior.join(progress, ["learner", group], "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("completed", F.lit(0))
    finished = (total > 0) & (done == total)
    reopened = ~finished & (F.col("status") == "completed")
    return rows.select(
        "learner", group,
        F.when(finished, "completed").when(reopened, "in_progress").otherwise(F.col("status")).alias("status"),
        F.when(finished, F.coalesce("started_at", now)).otherwise(F.col("started_at")).alias("started_at"),
        F.when(finished, F.coalesce("completed_at", now)).when(~reopened, F.col("completed_at")).alias("completed_at"),
        F.coalesce("percent", F.lit(0.0)).alias("percent"),
        F.coalesce("last_access", "last_accessed_at").alias("last_accessed_at"),
    )


def dashboards(
    courses: DataFrame, paths: DataFrame, progress: DataFrame, attempts: DataFrame
) -> DataFrame:
    """One row per learner: enrolments, mean percent, time and attempt statistics."""
    both = courses.select("learner", "percent", "total", "completed", F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(
        paths.select("learner", "percent", "total", "completed", F.lit(0).alias("c"), F.lit(1).alias("p"))
    )
    full = (F.col("total") > 0) & (F.col("total") == F.col("completed"))
    enrolments = both.groupBy("learner").agg(
        F.bround(F.avg("percent"), 2).alias("overall_percent"),
        F.sum("c").alias("courses"), F.sum("p").alias("paths"),
        F.count_if(full & (F.col("c") == 1)).alias("completed_courses"),
        F.count_if(full & (F.col("p") == 1)).alias("completed_paths"),
    )
    lessons = progress.groupBy("learner").agg(
        F.count_if("completed").alias("completed_lessons"), F.sum("seconds").alias("seconds")
    )
    tried = attempts.groupBy("learner").agg(
        F.count(F.lit(1)).alias("attempts_started"),
        F.count("submitted_at").alias("attempts_submitted"),
        F.count_if(F.col("passed")).alias("attempts_passed"),
        F.bround(F.avg("score_percent"), 2).alias("average_score"),
    )
    out = enrolments.join(lessons, "learner", "full_outer").join(tried, "learner", "full_outer")
    return out.fillna(0, [c for c in out.columns if c not in ("learner", "average_score")])


def recent_activity(completions: DataFrame, attempts: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` items per learner over both kinds; the rank filter limits map-side."""
    items = completions.unionByName(attempts)
    order = Window.partitionBy("learner").orderBy(F.desc("occurred_at"), F.desc("item_id"))
    return items.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def grade_automatically(
    answers: DataFrame, questions: DataFrame, options: DataFrame, passing: float = 70.0
) -> DataFrame:
    """(attempt, points_earned, points_possible, score, passed, grading_status).

    ``questions`` (attempt, question, type, points) lists every question of
    each attempt's assessment; ``answers`` (attempt, question, option) what
    was answered; ``options`` (attempt, question, option, is_correct).
    """
    keyed = answers.join(options, ["attempt", "question", "option"], "left").select(
        "attempt", "question", F.lit(True).alias("answered"), "is_correct"
    )
    rows = questions.join(keyed, ["attempt", "question"], "left")
    choice = F.col("type") != "short_answer"
    got = F.when(choice & F.col("answered") & F.col("is_correct"), F.col("points")).otherwise(0.0)
    per = rows.groupBy("attempt").agg(
        F.sum(got).alias("__e"), F.sum("points").alias("__p"),
        F.bool_and(choice & F.coalesce("answered", F.lit(False))).alias("__complete"),
        F.bool_or(~choice).alias("__manual"),
    )
    score = percentage(F.col("__e"), F.col("__p"))
    return per.select(
        "attempt",
        F.bround("__e", 4).alias("points_earned"), F.bround("__p", 4).alias("points_possible"),
        score.alias("score"),
        F.when(F.col("__complete"), score >= passing).alias("passed"),
        F.when(F.col("__complete"), "final").when(F.col("__manual"), "manual_grading_required")
        .otherwise("pending").alias("grading_status"),
    )


def number_attempts(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, maximum: int) -> DataFrame:
    """Add ``attempt_number`` and ``allowed`` (within the limit)."""
    out = with_running(attempts, list(keys), list(order), segment, {"attempt_number": F.lit(1)})
    return out.withColumn("allowed", F.col("attempt_number") <= maximum)


def latest_grades(grades: DataFrame) -> DataFrame:
    """(attempt, question, points) of the newest manual grade of each answer."""
    return grades.groupBy("attempt", "question").agg(
        F.max_by("points", F.struct("created_at", "grade_id")).alias("graded_points")
    )


def grade_history(grades: DataFrame, segment: Column) -> DataFrame:
    """Append-only history: each grade with the one it replaced."""
    out = with_neighbour(
        grades, ["attempt", "question"], ["created_at", "grade_id"], segment, {"previous_points": "points"}
    )
    kind = F.when(F.col("previous_points").isNull(), "manual_grade_created").otherwise("grade_changed")
    return out.withColumn("event_type", kind)


def recalculate(answers: DataFrame, grades: DataFrame, passing: float = 70.0) -> DataFrame:
    """Scores after manual grading.

    ``answers`` (attempt, question, type, points, awarded) has one row per
    question, ``awarded`` null when unanswered; short answers count through
    their newest grade only.
    """
    rows = answers.join(latest_grades(grades), ["attempt", "question"], "left")
    value = F.when(F.col("type") == "short_answer", F.col("graded_points")).otherwise(F.col("awarded"))
    per = rows.groupBy("attempt").agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("__e"), F.sum("points").alias("__p"),
        F.bool_and(value.isNotNull()).alias("__full"),
    )
    score = percentage(F.col("__e"), F.col("__p"))
    return per.select(
        "attempt", F.bround("__e", 4).alias("points_earned"), F.bround("__p", 4).alias("points_possible"),
        score.alias("score"), F.when(F.col("__full"), score >= passing).alias("passed"),
        F.when(F.col("__full"), "graded").otherwise("manual_grading_required").alias("grading_status"),
    )


def needs_grading(attempts: DataFrame, answers: DataFrame, grades: DataFrame) -> DataFrame:
    """Submitted attempts with a short answer that has no grade yet."""
    short = answers.filter("type = 'short_answer'").select("attempt", "question")
    open_answers = short.join(grades.select("attempt", "question"), ["attempt", "question"], "left_anti")
    return attempts.filter("submitted").join(open_answers.select("attempt"), "attempt", "left_semi")


def assessment_courses(assessments: DataFrame, modules: DataFrame, lessons: DataFrame) -> DataFrame:
    """(assessment, course, owners_ok): course found through exactly one owner."""
    m = modules.select(F.col("module").alias("module_id"), F.col("course").alias("__m"))
    by_module = modules.select(F.col("module"), F.col("course").alias("__l"))
    les = lessons.join(by_module, "module").select(F.col("lesson").alias("lesson_id"), "__l")
    rows = assessments.join(m, "module_id", "left").join(les, "lesson_id", "left")
    owners = sum(
        (F.col(c).isNotNull().cast("int") for c in ("course_id", "module_id", "lesson_id")), F.lit(0)
    )
    return rows.select(
        "assessment", F.coalesce("course_id", "__m", "__l").alias("course"), (owners == 1).alias("owners_ok")
    )


def lesson_progress(events: DataFrame) -> DataFrame:
    """State per (learner, lesson) after replaying start/access/time/update/complete/reset.

    The replay is a set of ordered maxima instead of a row-by-row fold: what
    counts is the newest reset, the first completion after it, and the work
    between them. ``events`` has learner, lesson, ts, event_id, kind, amount
    (seconds for time, percent for update; 100 percent completes).
    """
    at = F.struct("ts", "event_id")
    key = ["learner", "lesson"]
    kind = F.when((F.col("kind") == "update") & (F.col("amount") >= 100), "complete").otherwise(F.col("kind"))
    rows = events.withColumn("kind", kind).withColumn("__at", at)
    resets = rows.groupBy(*key).agg(F.max(F.when(F.col("kind") == "reset", F.col("__at"))).alias("__reset"))
    # many-to-one join on the key; adaptive execution splits a hot key
    rows = rows.join(resets, key)
    live = F.col("__reset").isNull() | (F.col("__at") > F.col("__reset"))
    done_at = rows.filter(live & (F.col("kind") == "complete")).groupBy(*key).agg(F.min("__at").alias("__done"))
    rows = rows.join(done_at, key, "left")
    # a finished lesson rejects updates and ignores a second completion
    open_ = live & (F.col("__done").isNull() | (F.col("__at") < F.col("__done")))
    begins = open_ & F.col("kind").isin("start", "update")
    touches = (
        F.col("kind").isin("start", "access", "time", "reset")
        | (open_ & (F.col("kind") == "update")) | (F.col("__at") == F.col("__done"))
    )
    out = rows.groupBy(*key).agg(
        F.min(F.when(begins, F.col("__at"))).alias("__begin"),
        F.first("__done").alias("__done"),
        F.max_by("amount", F.when(open_ & (F.col("kind") == "update"), F.col("__at"))).alias("__percent"),
        F.sum(F.when(F.col("kind") == "time", F.col("amount")).otherwise(0.0)).alias("seconds"),
        F.max(F.when(touches, F.col("ts"))).alias("last_accessed"),
    )
    started = F.coalesce("__begin.ts", "__done.ts")
    return out.select(
        *key,
        F.when(F.col("__done").isNotNull(), "completed")
        .when(F.col("__begin").isNotNull(), "in_progress").otherwise("not_started").alias("status"),
        F.when(F.col("__done").isNotNull(), 100.0)
        .otherwise(F.coalesce(F.bround("__percent", 2), F.lit(0.0))).alias("percent"),
        started.alias("started_at"), F.col("__done.ts").alias("completed_at"),
        "seconds", "last_accessed",
    )


def completion_log(events: DataFrame) -> DataFrame:
    """Append-only completions: the first one after each reset (or the start)."""
    key = ["learner", "lesson"]
    done = (F.col("kind") == "complete") | ((F.col("kind") == "update") & (F.col("amount") >= 100))
    marks = events.filter(done | (F.col("kind") == "reset")).withColumn("__reset", F.col("kind") == "reset")
    seen = with_neighbour(
        marks, key, ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), {"__after": "__reset"}
    )
    return seen.filter(~F.col("__reset") & F.coalesce("__after", F.lit(True))).select(
        *key, F.col("ts").alias("completed_at"), "event_id"
    )


def review_states(actions: DataFrame, final_scores: DataFrame) -> DataFrame:
    """(attempt, review_status, rejected): replayed review requests and decisions.

    ``actions`` (attempt, ts, event_id, action) with request, approve,
    changes, regrade; approval needs a final score. Two neighbouring facts
    decide every action, so segmented windows suffice: a decision counts when
    the previous counted action is a request.
    """
    legal = actions.join(final_scores.select("attempt").distinct().withColumn("__final", F.lit(True)), "attempt", "left")
    legal = legal.filter((F.col("action") != "approve") | F.coalesce("__final", F.lit(False)))
    # runs of requests count once and so do runs of decisions, so comparing
    # with the previous legal action is enough
    legal = legal.withColumn("__asks", F.col("action") == "request")
    seen = with_neighbour(
        legal, "attempt", ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), {"__asked": "__asks"}
    )
    counted = seen.filter(F.col("__asks") != F.coalesce("__asked", F.lit(False)))
    status = (
        F.when(F.col("action") == "request", "pending").when(F.col("action") == "approve", "approved")
        .when(F.col("action") == "changes", "changes_requested").otherwise("regraded")
    )
    kept = counted.groupBy("attempt").agg(
        F.max_by(status, F.struct("ts", "event_id")).alias("review_status"), F.count(F.lit(1)).alias("__k")
    )
    total = actions.groupBy("attempt").agg(F.count(F.lit(1)).alias("__n"))
    return total.join(kept, "attempt", "left").select(
        "attempt", F.coalesce("review_status", F.lit("none")).alias("review_status"),
        (F.col("__n") - F.coalesce("__k", F.lit(0))).alias("rejected"),
    )


def regrade_problems(submitted: DataFrame, answers: DataFrame) -> DataFrame:
    """(attempt, missing, unknown, repeated) of full regrades that are not exact.

    ``submitted`` (attempt, question) must hold every short answer once.
    """
    wanted = answers.filter("type = 'short_answer'").select("attempt", "question", F.lit(1).alias("w"), F.lit(0).alias("s"))
    given = submitted.select("attempt", "question", F.lit(0).alias("w"), F.lit(1).alias("s"))
    per = wanted.unionByName(given).groupBy("attempt", "question").agg(F.max("w").alias("w"), F.sum("s").alias("s"))
    out = per.groupBy("attempt").agg(
        F.count_if((F.col("w") == 1) & (F.col("s") == 0)).alias("missing"),
        F.count_if((F.col("w") == 0) & (F.col("s") > 0)).alias("unknown"),
        F.count_if(F.col("s") > 1).alias("repeated"),
    )
    return out.filter((F.col("missing") > 0) | (F.col("unknown") > 0) | (F.col("repeated") > 0))


def definition_problems(questions: DataFrame, options: DataFrame) -> DataFrame:
    """(question, problems) of badly formed assessment questions."""
    counts = options.groupBy("question").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("right")
    )
    rows = questions.join(counts, "question", "left").fillna(0, ["n", "right"])
    short = F.col("type") == "short_answer"
    found = reasons(
        (F.trim("prompt") == "", "prompt missing"),
        (F.col("points") < 0, "negative points"),
        (short & (F.col("n") > 0), "short answer with options"),
        (~short & (F.col("n") < 2), "fewer than two options"),
        ((F.col("type") == "true_false") & (F.col("n") >= 2) & (F.col("n") != 2), "true/false needs two options"),
        (~short & (F.col("n") >= 2) & (F.col("right") != 1), "not exactly one correct option"),
    )
    return rows.select("question", found.alias("problems")).filter(F.size("problems") > 0)


def identity_problems(learners: DataFrame, key: str, external: str, email: str, name: str) -> DataFrame:
    """(key, problems): missing, malformed or repeated learner identities.

    Repeats come from an aggregate joined back on the repeated values only.
    """
    rows = learners.select(
        key,
        F.nullif(F.trim(external), F.lit("")).alias("external_id"),
        F.nullif(F.lower(F.trim(email)), F.lit("")).alias("email"),
        F.trim(name).alias("__name"),
    )

    def repeated(column: str, flag: str) -> DataFrame:
        return (
            rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
            .filter("__n > 1").select(column, F.lit(True).alias(flag))
        )

    rows = rows.join(repeated("external_id", "__x"), "external_id", "left").join(
        repeated("email", "__m"), "email", "left"
    )
    bad_mail = ~F.contains("email", F.lit("@")) | F.startswith("email", F.lit("@")) | F.endswith("email", F.lit("@"))
    found = reasons(
        (F.col("external_id").isNull() & F.col("email").isNull(), "no identity"),
        (F.coalesce(bad_mail, F.lit(False)), "email malformed"),
        (F.coalesce("__name", F.lit("")) == "", "name missing"),
        (F.coalesce("__x", F.lit(False)), "external id repeated"),
        (F.coalesce("__m", F.lit(False)), "email repeated"),
    )
    return rows.select(key, found.alias("problems")).filter(F.size("problems") > 0)
