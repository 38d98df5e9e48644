"""Components of links added bit by bit, and the work of a step."""

import random

from loanspan.llm import components as c


def _frame(spark, links):
    return spark.createDataFrame(links, "u bigint, v bigint")


def _roots(df):
    return dict(map(tuple, df.collect()))


def test_links_added_to_stars_of_those_before(spark):
    draw = random.Random(5)
    first = [(draw.randrange(300), draw.randrange(300)) for _ in range(130)] + [(None, 3), (7, 7)]
    later = [(draw.randrange(300), draw.randrange(300)) for _ in range(60)] + [(i, i + 1) for i in range(400, 440)]
    before = c.components(_frame(spark, first))
    assert _roots(c.components(c.stars(before).union(_frame(spark, later)))) == _roots(
        c.components(_frame(spark, first + later))
    )


def test_components_found_before_take_one_step(spark, monkeypatch):
    chain = c.components(_frame(spark, [(i, i + 1) for i in range(60)]))
    steps, step = [], c._large_star
    monkeypatch.setattr(c, "_large_star", lambda links: steps.append(1) or step(links))
    assert set(_roots(c.components(c.stars(chain))).values()) == {0}
    assert len(steps) == 1


def test_a_step_deals_each_node_once(spark):
    links = c.written(_frame(spark, [(i, i // 2) for i in range(1, 400)]))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.sparkContext.setJobGroup("step", "one step")
        c.written(c._small_star(c._large_star(links)))
        status = spark.sparkContext.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("step") for s in status.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    # Each star reads its shuffle twice at most, and the distinct links are dealt once.
    assert 60 <= tasks < 130
