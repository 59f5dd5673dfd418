"""Follow-up tasks: planning, dependencies, matching of returns, status and active records."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chem
from ..scratch import cut
from . import evidence, graph

#: Step priorities and dependencies (fixed values).
PRIORITY = {"structure": 100, "verification": 96, "conditions": 94, "conflict": 90, "novelty": 86, "stability": 82, "target": 72, "experiment": 60}
STEPS = ["structure", "verification", "conditions", "novelty", "stability", "conflict", "target", "experiment"]
NEEDS = [("novelty", "structure"), ("stability", "structure"), ("stability", "conditions"), ("conflict", "conditions"), ("target", "structure"), ("target", "stability"), ("experiment", "stability"), ("experiment", "target")]


def campaign_scope(df: DataFrame, excluded: list[str], allowed: list[str], least: float) -> DataFrame:
    """reason: why a row is outside the campaign, or 'in scope'."""
    found = chem.formula_elements(F.col("formula"))
    lists = [F.array(*[F.lit(x) for x in xs]) for xs in (excluded, allowed)]
    reason = F.when(F.arrays_overlap(found, lists[0]), "excluded element").when(F.size(F.array_except(found, lists[1])) > 0, "outside allowed set").when(F.col("value") < least, "below threshold").otherwise("in scope")
    return df.withColumn("reason", reason)


def plan_tasks(groups: DataFrame) -> DataFrame:
    """One task for each group and required step, with priority, properties and a stable id.

    ``groups`` is the result of ``evidence.group_summary``.  A structure task is planned unless every record's
    structure is resolved; properties are those to measure for an experiment, those in conflict for a conflict.
    """
    need = {**evidence.required_steps(), "structure": ~F.col("resolved")}
    wanted = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("step"), F.lit(PRIORITY[s]).cast("long").alias("priority"))) for s, c in need.items()]))
    firm, open_ = F.array_except("agreed", "conflicts"), F.array_except("usable", "conflicts")
    properties = F.when(F.col("s.step") == "experiment", F.when(F.size(firm) > 0, firm).otherwise(open_)).when(F.col("s.step") == "conflict", F.col("conflicts")).otherwise(F.col("usable"))
    out = groups.withColumn("s", F.explode(wanted)).select("identity", "s.step", "s.priority", properties.alias("properties"))
    return out.withColumn("task_id", F.concat(F.lit("task-"), F.substring(F.sha2(F.concat_ws("~", "identity", "step"), 256), 1, 16)))


def dependencies(tasks: DataFrame) -> DataFrame:
    """(identity, step, needs) for steps whose prerequisite is planned too; the step table has eight rows."""
    edges = tasks.sparkSession.createDataFrame(NEEDS, "step string, needs string")
    planned = tasks.select("identity", F.col("step").alias("needs"))
    return tasks.join(F.broadcast(edges), "step").join(planned, ["identity", "needs"]).select("identity", "step", "needs")


def closure(edges: DataFrame) -> DataFrame:
    """(identity, step, needs): all prerequisites of each step, direct or through others, however deep."""
    node = lambda c: F.concat_ws("\x1f", "identity", c)
    reach = graph.closure(edges.select(node("step").alias("a"), node("needs").alias("b")))
    part = lambda c, i: F.split_part(c, F.lit("\x1f"), F.lit(i))
    return reach.select(part(F.col("a"), 1).alias("identity"), part(F.col("a"), 2).alias("step"), part(F.col("b"), 2).alias("needs"))


def judge_returns(returns: DataFrame, sources: DataFrame, groups: DataFrame) -> DataFrame:
    """record_id, identity, step, accepted of each returned claim, by the rule of its step.

    ``sources`` are the claims of the groups' own records.  A structure return must keep a source claim's value
    within 1e-12 (relative, at least absolute), a verification or conditions return one of its own model.
    """
    claims = sources.select("identity", "property", F.col("value").alias("source"), F.lower("model").alias("token")).distinct()
    pairs = returns.where(F.col("step").isin("structure", "verification", "conditions")).select("record_id", "identity", "property", "value", F.lower("model").alias("own")).join(claims, ["identity", "property"])
    close = F.abs(F.col("value") - F.col("source")) <= F.greatest(F.lit(1e-12), 1e-12 * F.abs("source"))
    kept = pairs.where(close).groupBy("record_id").agg(F.lit(True).alias("kept"), F.bool_or(F.col("own") == F.col("token")).alias("kept_own"))
    firm, open_ = F.array_except("agreed", "conflicts"), F.array_except("usable", "conflicts")
    context = groups.select("identity", F.when(F.size(firm) > 0, firm).otherwise(open_).alias("wanted"), (F.size("conflicts") == 0).alias("settled"))
    r = returns.join(kept, "record_id", "left").join(context, "identity")
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    dated = evidence.is_snapshot_date(F.col("data_cutoff"))
    public = F.exists("evidence", lambda k: k.rlike("^(doi|url|database-(hash|id)):"))
    full = F.col("eligible") & F.col("complete")
    rules = {
        "structure": F.col("eligible") & F.col("structure_resolved") & some("kept"),
        "verification": F.col("eligible") & some("kept_own"),
        "conditions": full & some("kept_own"),
        "novelty": F.col("eligible") & F.col("novelty_status").isin("known_reference", "screened_unverified") & dated & public,
        "stability": full & F.col("property").isin(*evidence.STABILITY),
        "target": F.col("calibrated"),
        "experiment": full & (F.col("stage") == "experiment") & F.col("structured") & F.array_contains("wanted", F.col("property")),
        "conflict": F.col("eligible") & F.col("supersedes") & F.col("settled"),
    }
    accepted = F.lit(False)
    for step, rule in rules.items():
        accepted = F.when(F.col("step") == step, rule).otherwise(accepted)
    return r.select("record_id", "identity", "step", accepted.alias("accepted"))


def task_status(planned: DataFrame, judged: DataFrame) -> DataFrame:
    """identity, step, task_status, verified, returned of each task: verified, returned_unverified or assigned."""
    n = judged.groupBy("identity", "step").agg(F.count_if("accepted").alias("verified"), F.count("*").alias("returned"))
    s = planned.select("identity", "step").join(n, ["identity", "step"], "left").na.fill(0, ["verified", "returned"])
    return s.withColumn("task_status", F.when(F.col("verified") > 0, "verified").when(F.col("returned") > 0, "returned_unverified").otherwise("assigned"))


def blocked(statuses: DataFrame, edges: DataFrame) -> DataFrame:
    """identity, step, blocked: whether a planned prerequisite has no verified return."""
    of = statuses.select("identity", F.col("step").alias("needs"), (F.col("verified") == 0).alias("open"))
    waits = edges.join(of, ["identity", "needs"]).groupBy("identity", "step").agg(F.bool_or("open").alias("waits"))
    return statuses.join(waits, ["identity", "step"], "left").select("identity", "step", F.coalesce("waits", F.lit(False)).alias("blocked"))


def execution_summary(statuses: DataFrame, waits: DataFrame, groups: DataFrame) -> DataFrame:
    """step, task_status, blocked, tasks, returned, claims: how many tasks stand where, with how many returned records,
    and how many of them belong to groups whose properties agree."""
    s = statuses.join(waits, ["identity", "step"]).join(groups.select("identity", "claim"), "identity")
    return s.groupBy("step", "task_status", "blocked").agg(F.count("*").alias("tasks"), F.sum("returned").alias("returned"), F.count_if("claim").alias("claims"))


def _step_place() -> Column:
    """The step's place in ``progress``, from 0; steps that aren't known count with the first step."""
    order = STEPS[::-1]
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("step")), F.lit(0)), F.lit(len(order))) - 1


def _own_progress() -> Column:
    verified = F.coalesce("verified", F.lit(0)).cast("long")
    return F.array(*[F.when(_step_place() == i, F.greatest(verified, F.lit(0))).otherwise(F.lit(0)).cast("long") for i in range(len(STEPS))])


def progress_vectors(tasks: DataFrame, reach: DataFrame) -> DataFrame:
    """task_id, progress: verified returns by step, the last step first, of a task and of all tasks that need it.

    ``tasks`` has task_id, step, verified; ``reach`` (a, b) says that task a needs task b, directly or through others.
    Steps that aren't known count with the first step.  Only tasks with verified returns travel.
    """
    order = STEPS[::-1]
    given = tasks.where("verified > 0").select("task_id", _step_place().alias("at"), "verified")
    onward = given.join(reach.select(F.col("a").alias("task_id"), "b"), "task_id").select(F.col("b").alias("task_id"), "at", "verified")
    sums = given.unionByName(onward).groupBy("task_id").agg(F.array(*[F.sum(F.when(F.col("at") == i, F.col("verified")).otherwise(0)) for i in range(len(order))]).alias("progress"))
    none = F.array_repeat(F.lit(0).cast("long"), len(order))
    return tasks.select("task_id").join(sums, "task_id", "left").select("task_id", F.coalesce("progress", none).alias("progress"))


def _placed(tasks: DataFrame) -> DataFrame:
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STEPS)), F.col("step")), F.lit(0)), F.lit(len(STEPS) + 1))
    return tasks.withColumns({"place": place, "depends_on": F.array_sort(F.array_distinct("depends_on"))})


def authoritative(tasks: DataFrame) -> DataFrame:
    """logical_key, task_id, active, reason: which of the tasks of each logical key speaks for it.

    ``tasks`` has task_id, logical_key, step, claims (how many source claims it asks for), depends_on and progress
    (``progress_vectors``).  Keys are settled in order of their step, then of the key: a task can be chosen only if
    all that it depends on has been chosen for its key before.  Of these the one with the greatest progress vector
    speaks (the last step counts first), then the one of most claims, or of fewest if there is no progress, then
    the smallest id.  Others have a reason: duplicate_logical_task (``active`` names the chosen task) or
    incompatible_dependency_manifest (none could be chosen).  Steps that aren't known come last.
    """
    tasks = cut(_placed(tasks).select("task_id", "logical_key", "place", "claims", "depends_on", "progress"))
    return _answers(tasks, _settled(tasks, tasks))


def authoritative_tasks(tasks: DataFrame) -> DataFrame:
    """``authoritative`` of tasks (task_id, logical_key, step, claims, verified, depends_on), with progress worked out here.

    Only tasks that others need have more progress than their own returns.  They are looked up once; dependencies are
    followed among them, and returns are added up for each distinct list of dependencies before they travel.
    """
    tasks = cut(_placed(tasks).select("task_id", "logical_key", "step", "place", "claims", "depends_on", "verified"))
    own = tasks.withColumn("progress", _own_progress())
    given = tasks.where((F.size("depends_on") > 0) & (F.col("verified") > 0))
    given = given.groupBy("depends_on").agg(*[F.sum(F.when(_step_place() == i, F.col("verified")).otherwise(0)).alias(f"p{i}") for i in range(len(STEPS))])
    given = given.select("depends_on", F.array(*[f"p{i}" for i in range(len(STEPS))]).alias("given"))
    lists = tasks.where(F.size("depends_on") > 0).select("depends_on").distinct()
    wanted = cut(lists.select(F.explode("depends_on").alias("task_id")).distinct())
    needed = cut(own.join(wanted, "task_id", "left_semi"))
    edges = needed.select(F.col("task_id").alias("a"), F.explode("depends_on").alias("b"))
    reach = graph.closure(edges).groupBy(F.col("a").alias("need")).agg(F.collect_list("b").alias("far"))
    step = given.withColumn("need", F.explode("depends_on")).join(reach, "need", "left")
    met = F.concat(F.array("need"), F.coalesce("far", F.array().cast("array<string>")))
    all_ = step.groupBy("depends_on").agg(F.any_value("given").alias("given"), F.array_distinct(F.flatten(F.collect_list(met))).alias("all"))
    sums = all_.select(F.explode("all").alias("task_id"), "given").groupBy("task_id").agg(F.array(*[F.sum(F.get("given", F.lit(i))) for i in range(len(STEPS))]).alias("more"))
    full = needed.join(sums, "task_id", "left").withColumn("progress", F.when(F.col("more").isNull(), F.col("progress")).otherwise(F.zip_with("progress", "more", lambda x, y: x + y)))
    columns = ["task_id", "logical_key", "place", "claims", "depends_on", "progress"]
    # A needed task also stands here with its own returns alone.  With all of them it comes before that row, so the first stays right.
    return _answers(tasks, _settled(own.select(*columns).unionByName(full.select(*columns)), needed))


def _settled(tasks: DataFrame, needed: DataFrame) -> DataFrame:
    """logical_key, active: the chosen task of each key that has one.  ``needed`` (task_id, logical_key, place) holds all tasks
    that are depended on.

    Tasks of one key and one list of dependencies can be chosen together or not at all, so the first of each list stands
    for them.  A round settles all keys of a step that wait for no other key of that step, so there are about as many
    rounds as steps; each is a join and a grouping of that step's lists.
    """
    some = F.exists("progress", lambda n: n > 0)
    best = F.min(F.struct(F.transform("progress", lambda n: -n).alias("p"), F.when(some, -F.col("claims")).otherwise(F.col("claims")).alias("c"), "task_id")).alias("best")
    groups = cut(tasks.groupBy("place", "logical_key", "depends_on").agg(best))
    needs = cut(groups.select("place", "logical_key", "depends_on", F.explode("depends_on").alias("need")))
    where = needed.select(F.col("task_id").alias("need"), F.col("logical_key").alias("need_key"), F.col("place").alias("need_place"))
    # Within a step a key waits for the smaller keys that its tasks depend on.
    same = needs.join(where, "need").where((F.col("place") == F.col("need_place")) & (F.col("need_key") < F.col("logical_key")))
    waits = cut(same.select("place", "logical_key", "need_key").distinct())
    chosen = [groups.select("logical_key", F.col("best.task_id").alias("active")).limit(0)]
    waiting, needing = ({p for (p,) in df.select("place").distinct().collect()} for df in (waits, needs))
    for (place_,) in sorted(groups.select("place").distinct().collect()):
        todo = groups.where(F.col("place") == place_)
        left = todo.select("logical_key").distinct()
        unsettled = True
        while unsettled:
            ready = todo
            if unsettled := place_ in waiting:
                open_ = waits.where(F.col("place") == place_).join(left.select(F.col("logical_key").alias("need_key")), "need_key", "left_semi").select("logical_key").distinct()
                ready = todo.join(left.join(open_, "logical_key", "left_anti"), "logical_key", "left_semi")
                left = cut(left.join(open_, "logical_key", "left_semi"))
                unsettled = not left.isEmpty()
            if place_ in needing:
                unmet = needs.where(F.col("place") == place_).join(reduce(DataFrame.unionByName, chosen).select(F.col("active").alias("need")), "need", "left_anti")
                ready = ready.join(unmet.select("logical_key", "depends_on").distinct(), ["logical_key", "depends_on"], "left_anti")
            chosen.append(cut(ready.groupBy("logical_key").agg(F.min("best").alias("best")).select("logical_key", F.col("best.task_id").alias("active"))))
    return reduce(DataFrame.unionByName, chosen)


def _answers(tasks: DataFrame, active: DataFrame) -> DataFrame:
    reason = F.when(F.col("active").isNull(), "incompatible_dependency_manifest").when(F.col("active") != F.col("task_id"), "duplicate_logical_task")
    return tasks.select("logical_key", "task_id").join(active, "logical_key", "left").select("logical_key", "task_id", "active", reason.alias("reason"))


def _entries(df: DataFrame, column: str = "properties") -> DataFrame:
    """The map ``column`` as sorted pairs (p, v), which can be grouped and compared; pairs stay as they are."""
    if df.schema[column].dataType.typeName() != "map":
        return df
    return df.withColumn(column, F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("p"), e["value"].alias("v")))))


def _spend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task_id, covered) of rows sorted by task: returns (asked false) first, then claims, each in order.

    A task's distinct returns are held, its claims pass by one at a time.  Returns are found by the value of the
    claim's first property, and used in order.
    """
    task, stock, by_model, by_value, covered, seen = None, [], {}, {}, True, False
    done, flags = [], []

    def near(model: str, want: list[tuple]) -> list[int]:
        if not want:
            return by_model.get(model, [])
        (name, v), *_ = want
        pairs = by_value.get((model, name), [])
        if not isinstance(pairs, tuple):
            pairs.sort()
            pairs = by_value[model, name] = tuple(pairs)
        reach = 2 * max(1e-12, abs(v) * 1e-12)
        return sorted(i for _, i in pairs[bisect_left(pairs, (v - reach,)) : bisect_right(pairs, (v + reach, len(stock)))])

    for batch in batches:
        for t, asked, model, properties, n in zip(*(batch.column(c).to_pylist() for c in ("task_id", "asked", "model", "properties", "n")), strict=True):
            if t != task:
                if seen:
                    done.append(task)
                    flags.append(covered)
                task, stock, by_model, by_value, covered, seen = t, [], {}, {}, True, False
            pairs = [(x["p"], x["v"]) for x in properties]
            if not asked:
                by_model.setdefault(model, []).append(len(stock))
                for p, v in dict(pairs).items():
                    if v is not None:
                        by_value.setdefault((model, p), []).append((v, len(stock)))
                stock.append([dict(pairs), n])
                continue
            seen = True
            for i in near(model, pairs) if covered else ():
                known, left = stock[i]
                if left and all(known.get(p) is not None and abs(known[p] - v) <= max(1e-12, abs(v) * 1e-12) for p, v in pairs):
                    used = min(n, left)
                    n, stock[i][1] = n - used, left - used
                    if not n:
                        break
            covered = covered and not n
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done, batch.schema.field("task_id").type), pa.array(flags, pa.bool_())], ["task_id", "covered"])
            done, flags = [], []
        kind = batch.schema.field("task_id").type
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([task], kind), pa.array([covered], pa.bool_())], ["task_id", "covered"])


def cover_claims(returns: DataFrame, claims: DataFrame) -> DataFrame:
    """task_id, covered: whether each claim (task_id, properties) of a task is met by a return of its own.

    A return meets a claim if it has all its properties with the same values (1e-12) and, where both tables have a
    ``model``, the same model.  Equal claims and equal returns of a task are counted first, so a task meets its
    distinct claims only, in order; tasks without claims are left out.  Tasks lie in sorted partitions that are read
    as a stream, many tasks a batch.
    """
    by_model = "model" in returns.columns and "model" in claims.columns

    def counted(df: DataFrame, asked: bool) -> DataFrame:
        model = F.coalesce(F.lower("model"), F.lit("")) if by_model else F.lit("")
        return _entries(df.where("task_id IS NOT NULL")).groupBy("task_id", F.lit(asked).alias("asked"), model.alias("model"), "properties").agg(F.count("*").alias("n"))

    both = counted(returns, False).unionByName(counted(claims, True))
    kind = claims.schema["task_id"].dataType.simpleString()
    return both.repartition("task_id").sortWithinPartitions("task_id", "asked", "model", "properties").mapInArrow(_spend, f"task_id {kind}, covered boolean")


def resolve(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """record_id, state: what is active once accepted returns have replaced what they stand for.

    ``records`` has record_id, identity, task_id (null for a record of no task), model, properties (map), evidence and
    supersedes (ids, compared without case), eligible, novelty_status, matched (of its task's lineage and executor) and
    satisfies (the rule of its step, ``judge_returns``).  ``tasks`` has task_id, step, source_identity, depends_on and
    conflict_properties.  In this order, each seeing what those before decided:

    1. returns of no known task are ``manifest_missing``, those that don't match are ``quarantined``;
    2. structure and conditions returns are accepted if those of the task cover all its source claims, which are then
       migrated; a verification's are accepted likewise, but replace nothing.  Source claims are records of the source
       identity of no task, or of a task that this one depends on;
    3. novelty returns of a source identity are accepted if all say the same status;
    4. a conflict return is accepted if it is eligible, has a conflicting property, names known evidence of its source
       identity, and has all properties of the records with that evidence, which are then superseded;
    5. other steps' returns are accepted if they satisfy; whatever is not accepted is ``rejected``;
    6. migrated records and those of superseded evidence are ``superseded``, the rest is ``active``.
    """
    t = tasks.select("task_id", "step", "source_identity", "depends_on", "conflict_properties")
    ids = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    r = _entries(records).withColumns({"evidence": ids(F.col("evidence")), "supersedes": ids(F.col("supersedes"))})
    known = r.join(t.withColumn("known", F.lit(True)), "task_id", "left")
    out = F.when(F.col("task_id").isNull(), None).when(F.col("known").isNull(), "manifest_missing").when(~F.coalesce("matched", F.lit(False)), "quarantined")
    r = cut(known.withColumn("state", out).drop("known", "matched"))
    live = r.where("state IS NULL")
    back = live.where("task_id IS NOT NULL")

    # 2: claims of the source identity against the returns of the task.
    asks = t.where(F.col("step").isin("structure", "conditions", "verification")).join(back.select("task_id").distinct(), "task_id", "left_semi")
    source = live.select(F.col("identity").alias("source_identity"), F.col("task_id").alias("of"), "record_id", "model", "properties")
    claims = asks.join(source, "source_identity").where(F.col("of").isNull() | ((F.col("of") != F.col("task_id")) & F.array_contains("depends_on", F.col("of"))))
    claims = cut(claims.select("task_id", "step", "source_identity", "record_id", "model", "properties"))
    items = back.where(F.coalesce("satisfies", F.lit(False)))
    covered = None
    for steps, columns in ((["structure"], ["task_id", "properties"]), (["conditions", "verification"], ["task_id", "model", "properties"])):
        of = lambda df: df.where(F.col("step").isin(*steps)).select(*columns)  # noqa: B023, E731
        part = cover_claims(of(items), of(claims)).where("covered").select("task_id")
        covered = part if covered is None else covered.unionByName(part)
    covered = cut(covered)
    met = items.join(covered, "task_id", "left_semi")
    # A return that meets none of the claims is no part of the migration; claims are compared as sorted pairs.
    want = claims.where("step <> 'verification'").join(covered, "task_id", "left_semi").select("task_id", "step", F.lower("model").alias("m"), F.col("properties").alias("asked")).distinct()
    close = lambda h, e: (h["p"] == e["p"]) & (F.abs(h["v"] - e["v"]) <= F.greatest(F.lit(1e-12), F.abs(e["v"]) * 1e-12))
    full = F.forall("asked", lambda e: F.exists("properties", lambda h: close(h, e)))
    classes = met.where("step <> 'verification'").select("task_id", "model", "properties").distinct()
    fits = classes.join(want, "task_id").where(((F.col("step") == "structure") | (F.lower("model") == F.col("m"))) & full).select(*classes.columns).distinct()
    moved = met.where("step <> 'verification'").join(fits, ["task_id", "model", "properties"], "left_semi")
    accepted = moved.select("record_id").unionByName(met.where("step = 'verification'").select("record_id"))
    migrated = claims.where("step <> 'verification'").join(covered, "task_id", "left_semi").select("record_id").distinct()

    # 3: one status for each source identity.
    from_ = F.coalesce("source_identity", "identity")
    novel = items.where("step = 'novelty'").withColumn("from", from_)
    agreed = novel.groupBy("from").agg(F.min("novelty_status").alias("low"), F.max("novelty_status").alias("high")).where(F.col("low").eqNullSafe(F.col("high")))
    accepted = accepted.unionByName(novel.join(agreed, "from", "left_semi").select("record_id"))

    # 4: evidence that a conflict return asks to replace, and the properties of the records that have it.
    asked = back.where((F.col("step") == "conflict") & F.col("eligible") & (F.size("supersedes") > 0)).withColumn("from", from_).withColumn("given", F.transform("properties", lambda e: e["p"]))
    asked = cut(asked.where(F.arrays_overlap("given", "conflict_properties")).select("record_id", "task_id", "from", "given", "conflict_properties", F.array_distinct("supersedes").alias("supersedes")))
    held = r.select(F.col("task_id").alias("of"), F.col("identity").alias("from"), F.transform("properties", lambda e: e["p"]).alias("has"), F.explode(F.array_distinct("evidence")).alias("id"))
    holders = held.select("from", "id", "of", "has").distinct()
    hits = asked.select("record_id", "task_id", "from", "given", "conflict_properties", F.explode("supersedes").alias("id")).join(holders, ["from", "id"])
    hits = hits.where((F.col("of").isNull() | (F.col("of") != F.col("task_id"))) & F.arrays_overlap("has", "conflict_properties"))
    enough = hits.groupBy("record_id").agg(F.count_distinct("id").alias("ids"), F.bool_and(F.size(F.array_except("has", "given")) == 0).alias("covers"))
    solved = cut(asked.join(enough, "record_id").where(F.col("covers") & (F.col("ids") == F.size("supersedes"))).select("record_id", "from", "supersedes"))
    accepted = accepted.unionByName(solved.select("record_id"))
    replaced = solved.select("from", F.explode("supersedes").alias("id")).distinct()

    # 5 and 6
    others = items.where(~F.col("step").isin("structure", "conditions", "verification", "novelty", "conflict"))
    accepted = cut(accepted.unionByName(others.select("record_id")).distinct())
    old = live.select("record_id", F.col("identity").alias("from"), F.explode("evidence").alias("id")).join(replaced, ["from", "id"], "left_semi").select("record_id").distinct().join(solved, "record_id", "left_anti")
    # Leaves of a migration that stayed in the source identity aren't replaced by it.
    leaves = moved.where(F.col("identity") == F.col("source_identity")).select("record_id")
    old = cut(migrated.join(leaves, "record_id", "left_anti").unionByName(old).distinct())
    final = r.join(accepted.withColumn("ok", F.lit(True)), "record_id", "left").join(old.withColumn("old", F.lit(True)), "record_id", "left")
    rejected = F.col("task_id").isNotNull() & F.col("ok").isNull()
    state = F.coalesce("state", F.when(rejected, "rejected").when(F.col("old"), "superseded").otherwise("active"))
    return final.select("record_id", state.alias("state"))


def branch_lineage(accepted: DataFrame) -> DataFrame:
    """identity, step, lineage: a new lineage for each destination (``descriptor``) of accepted structure and condition returns."""
    moved = accepted.where(F.col("step").isin("structure", "conditions"))
    name = F.concat("identity", F.lit("|branch:"), "step", F.lit(":"), F.substring(F.sha2("descriptor", 256), 1, 16))
    return moved.select("identity", "step", name.alias("lineage")).distinct()


def remainder_lineage(sources: DataFrame, moved: DataFrame) -> DataFrame:
    """identity, lineage of groups from which records were moved while others stayed: (identity, record_id) in both."""
    left = sources.join(moved.select("identity", "record_id"), ["identity", "record_id"], "left_anti").join(moved.select("identity").distinct(), "identity", "left_semi")
    # Order-free digest of the records that stay, so no group is gathered.
    digest = F.hex(F.bit_xor(F.xxhash64("record_id")))
    return left.groupBy("identity").agg(F.concat(F.first("identity"), F.lit("|remainder:"), digest).alias("lineage"))


def match_returns(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """match: whether a returned record belongs to a task of its lineage and comes from the task's executor."""
    status = F.when(F.col("executor").isNull(), "unknown task").when(F.col("executor") != F.col("family"), "unauthorised executor").otherwise("matched")
    return records.join(assigned, "identity", "left").withColumn("match", status)
