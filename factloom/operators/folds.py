"""State machines over ordered moves (V2), without a list or a task per entity.

A run of moves is a map from the status before it to the status after it, with
the number of illegal moves from each start. Such maps compose. All moves are
put in one order and cut into blocks of bounded size; the moves of an entity in
a block become one map, up to ``WIDTH`` maps of an entity one map of the next
level, and so on, so that an entity with very many moves is a tree of small
groups. Start statuses go down the same tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.scaling import dense_index
from factloom.session import ensure_checkpoint_dir
from factloom.vocab import STATE_MACHINES

#: Moves of a block, and maps that are composed at a time.
WIDTH = 256


def _legal(machine: str) -> Column:
    return F.array(*[F.lit(f"{s}>{t}") for s, targets in STATE_MACHINES[machine].items() for t in targets])


def _state(state: Column, illegal: Column) -> Column:
    return F.struct(state.alias("state"), illegal.cast("bigint").alias("illegal"))


def _run(moves: str, start: Column, legal: Column) -> Column:
    """Status and number of illegal moves behind a list of moves; an illegal move is skipped."""
    def step(acc: Column, move: Column) -> Column:
        ok = F.array_contains(legal, F.concat(acc["state"], F.lit(">"), move["to_status"]))
        return _state(F.when(ok, move["to_status"]).otherwise(acc["state"]), acc["illegal"] + F.when(ok, 0).otherwise(1))

    return F.aggregate(moves, _state(start, F.lit(0)), step)


def _through(maps: Column, start: Column) -> Column:
    """Status and number of illegal moves behind a list of maps."""
    def step(acc: Column, item: Column) -> Column:
        reached = F.element_at(item["map"], acc["state"])
        return _state(reached["state"], acc["illegal"] + reached["illegal"])

    return F.aggregate(maps, _state(start, F.lit(0)), step)


def _ordered(maps: str) -> Column:
    # Maps do not sort, so the order is taken from the block.
    return F.array_sort(maps, lambda a, b: F.when(a["block"] < b["block"], -1).when(a["block"] > b["block"], 1).otherwise(0))


def _stored(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _levels(events: DataFrame, machine: str) -> tuple[DataFrame, list[DataFrame]]:
    """Blocks of moves, and maps per entity and block, level by level up to one map an entity."""
    states, legal = list(STATE_MACHINES[machine]), _legal(machine)
    every = lambda run: F.map_from_arrays(F.array(*[F.lit(s) for s in states]), F.array(*[run(F.lit(s)) for s in states]))
    placed = dense_index(events.select("entity_id", "at", "event_id", "to_status"), ["entity_id", "at", "event_id", "to_status"])
    move = F.struct("idx", "event_id", "to_status")
    blocks = _stored(placed.groupBy("entity_id", F.expr(f"idx div {WIDTH}").alias("block")).agg(F.array_sort(F.collect_list(move)).alias("moves")))
    levels = [_stored(blocks.select("entity_id", "block", F.size("moves").cast("bigint").alias("n"), every(lambda s: _run("moves", s, legal)).alias("map")))]
    last = levels[0].agg(F.max("block")).first()[0] or 0
    while last:
        last //= WIDTH
        grouped = levels[-1].groupBy("entity_id", F.expr(f"block div {WIDTH}").alias("_up")).agg(
            F.sum("n").alias("n"), F.collect_list(F.struct("block", "map")).alias("_maps")
        ).withColumn("_maps", _ordered("_maps"))
        levels.append(_stored(grouped.select("entity_id", F.col("_up").alias("block"), "n", every(lambda s: _through(F.col("_maps"), s)).alias("map"))))
    return blocks, levels


def fold_states(events: DataFrame, machine: str, initial: str) -> DataFrame:
    """V2: final status per entity from ``events(entity_id, at, event_id, to_status)``; an illegal move writes nothing."""
    _, levels = _levels(events, machine)
    end = F.element_at("map", F.lit(initial))
    return levels[-1].select(
        "entity_id", F.col("n").alias("events"), end["state"].alias("final_status"), end["illegal"].alias("illegal_moves")
    )


def state_before(events: DataFrame, machine: str, initial: str) -> DataFrame:
    """V2: every move ``(entity_id, event_id, to_status)`` with the status before it and whether it is legal."""
    legal = _legal(machine)
    blocks, levels = _levels(events, machine)
    starts = levels[-1].select("entity_id", "block", F.lit(initial).alias("start"))
    for lower in reversed(levels[:-1]):
        # The maps of a group, run through once from its start: the status before each of them.
        group = lower.withColumn("_up", F.expr(f"block div {WIDTH}")).groupBy("entity_id", "_up").agg(
            F.collect_list(F.struct("block", "map")).alias("_maps")
        ).join(starts.withColumnRenamed("block", "_up"), ["entity_id", "_up"])

        def step(acc: Column, item: Column) -> Column:
            return F.struct(
                F.array_append(acc["seen"], F.struct(item["block"].alias("block"), acc["state"].alias("start"))).alias("seen"),
                F.element_at(item["map"], acc["state"])["state"].alias("state"),
            )

        none = F.array().cast("array<struct<block:bigint,start:string>>")
        walked = F.aggregate(_ordered("_maps"), F.struct(none.alias("seen"), F.col("start").alias("state")), step)
        starts = _stored(group.select("entity_id", F.explode(walked["seen"]).alias("_s")).select("entity_id", "_s.block", "_s.start"))

    def move(acc: Column, item: Column) -> Column:
        ok = F.array_contains(legal, F.concat(acc["state"], F.lit(">"), item["to_status"]))
        row = F.struct(
            item["event_id"].alias("event_id"), item["to_status"].alias("to_status"), acc["state"].alias("from_status"), ok.alias("legal")
        )
        return F.struct(F.array_append(acc["seen"], row).alias("seen"), F.when(ok, item["to_status"]).otherwise(acc["state"]).alias("state"))

    kind = events.schema["event_id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<event_id:{kind},to_status:string,from_status:string,legal:boolean>>")
    walked = F.aggregate("moves", F.struct(none.alias("seen"), F.col("start").alias("state")), move)
    return blocks.join(starts, ["entity_id", "block"]).select("entity_id", F.explode(walked["seen"]).alias("_m")).select("entity_id", "_m.*")
