"""The join fixture with closed-form counts, null comparisons, residuals, empty sides, chains, plans."""

from collections import Counter

import pytest

from lumenfold.operators import JOIN_TYPES, hash_join, repeat_rows

LEFT = [(None, "a"), (0, "b"), (1111, "c"), (2, "d"), (3333, "e"), (4, None), (4, "f"), (5555, "g"), (6666, "h"), (7, "i")]
RIGHT = [("i", None), ("h", 0), ("g", 1), ("f", 2), ("e", 2), ("d", 3), ("c", 3), (None, 4), ("b", 5), ("a", 6)]
COUNTS = {
    "inner": lambda l, r: 5 * l * r,  # noqa: E741
    "left_outer": lambda l, r: 5 * l * r + (10 * l if r == 0 else 6 * l),  # noqa: E741
    "right_outer": lambda l, r: 5 * l * r + (10 * r if l == 0 else 6 * r),  # noqa: E741
    "full_outer": lambda l, r: 5 * l * r + (10 if r == 0 else 6) * l + (10 if l == 0 else 6) * r,  # noqa: E741
    "left_semi": lambda l, r: 4 * l if r else 0,  # noqa: E741
    "left_anti": lambda l, r: 6 * l if r else 10 * l,  # noqa: E741
    "right_semi": lambda l, r: 4 * r if l else 0,  # noqa: E741
    "right_anti": lambda l, r: 6 * r if l else 10 * r,  # noqa: E741
}


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(LEFT, "l_i32 int, l_str string"), spark.createDataFrame(RIGHT, "r_str string, r_i32 int")


def plain(how, same=lambda a, b: a is not None and a == b, extra=lambda l, r: True):  # noqa: E741
    """The join by brute force."""
    match = {(i, j) for i, a in enumerate(LEFT) for j, b in enumerate(RIGHT) if same(a[0], b[1]) and extra(a, b)}
    left_hit, right_hit = {i for i, _ in match}, {j for _, j in match}
    if how.endswith(("semi", "anti")):
        side, hit = (LEFT, left_hit) if how.startswith("left") else (RIGHT, right_hit)
        return Counter(row for i, row in enumerate(side) if (i in hit) == how.endswith("semi"))
    out = [LEFT[i] + RIGHT[j] for i, j in match]
    if how in ("left_outer", "full_outer"):
        out += [row + (None, None) for i, row in enumerate(LEFT) if i not in left_hit]
    if how in ("right_outer", "full_outer"):
        out += [(None, None) + row for j, row in enumerate(RIGHT) if j not in right_hit]
    return Counter(out)


@pytest.mark.parametrize("how", JOIN_TYPES)
def test_rows(sides, how):
    assert Counter(map(tuple, hash_join(*sides, ["l_i32"], ["r_i32"], how).collect())) == plain(how)


@pytest.mark.parametrize("how", JOIN_TYPES)
@pytest.mark.parametrize("ml,mr", [(0, 1), (1, 0), (2, 3)])
def test_counts(sides, how, ml, mr):
    left, right = repeat_rows(sides[0], ml), repeat_rows(sides[1], mr)
    assert hash_join(left, right, ["l_i32"], ["r_i32"], how).count() == COUNTS[how](ml, mr)


@pytest.mark.parametrize("how", JOIN_TYPES)
def test_null_safe(sides, how):
    got = Counter(map(tuple, hash_join(*sides, ["l_i32"], ["r_i32"], how, key_cmp=["IS"]).collect()))
    assert got == plain(how, same=lambda a, b: a == b)


@pytest.mark.parametrize("how", JOIN_TYPES)
def test_residual_is_part_of_the_condition(sides, how):
    got = hash_join(*sides, ["l_i32"], ["r_i32"], how, residual=lambda l, r: l("l_str") < r("r_str"))  # noqa: E741
    assert Counter(map(tuple, got.collect())) == plain(how, extra=lambda a, b: a[1] is not None and b[0] is not None and a[1] < b[0])


@pytest.mark.parametrize("strategy,node", [("broadcast", "BroadcastHashJoin"), ("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_strategy(sides, strategy, node):
    joined = hash_join(*sides, ["l_i32"], ["r_i32"], strategy=strategy)
    assert joined.count() == 5
    assert node in joined._jdf.queryExecution().executedPlan().toString()


def test_null_safe_keys_stay_an_equi_join(sides):
    joined = hash_join(*sides, ["l_i32", "l_str"], ["r_i32", "r_str"], key_cmp=["IS", "EQ"], strategy="merge")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("how,right_deep,left_deep", [("inner", 7, 7), ("right_semi", 4, 4), ("left_anti", 5, 6), ("full_outer", 25, 25)])
def test_chains(sides, how, right_deep, left_deep):
    left, right = sides
    first = hash_join(left, right, ["l_i32"], ["r_i32"], how)
    last = first.columns[0] if how == "left_anti" else first.columns[-1]
    assert hash_join(left.toDF("a", "b"), first, ["a"], [last], how).count() == right_deep
    key = first.columns[1] if how == "right_semi" else first.columns[0]
    assert hash_join(first, right.toDF("x", "y"), [key], ["y"], how).count() == left_deep


def test_output_and_suffixes(sides):
    left = sides[0]
    joined = hash_join(left, left, ["l_i32"], ["l_i32"], left_output=["l_str"], right_output=["l_str", "l_i32"], suffixes=("_x", "_y"))
    assert joined.columns == ["l_str_x", "l_str_y", "l_i32"]
    assert joined.count() == 11


def test_bad_arguments(sides):
    for bad in ({"how": "cross"}, {"left_keys": []}, {"right_keys": ["r_i32", "r_str"]}, {"left_keys": ["nope"]}, {"key_cmp": ["LIKE"]}, {"strategy": "luck"}):
        with pytest.raises(ValueError):
            hash_join(*sides, **({"left_keys": ["l_i32"], "right_keys": ["r_i32"]} | bad))


def test_boolean_fixture(spark):
    build = spark.createDataFrame([(None, True), (0, False), (1, False), (2, None), (3, False), (4, False)] * 4, "i int, b boolean")
    probe = spark.createDataFrame([(0, False), (0, True), (1, False), (2, None)], "i int, b boolean")
    full = spark.createDataFrame([(0, False), (0, True), (None, None), (1, False), (2, None), (5, True)], "i int, b boolean")
    count = lambda p, how: hash_join(p, build, ["i"], ["i"], how, suffixes=("", "_r")).count()
    assert [count(probe, "right_outer"), count(probe, "right_semi"), count(probe, "right_anti"), count(full, "full_outer")] == [28, 12, 12, 30]


def test_broadcast_only_what_is_small(spark, sides, monkeypatch):
    from lumenfold.operators import join

    monkeypatch.setattr(join, "BROADCAST_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hash_join(*sides, ["l_i32"], ["r_i32"], strategy="broadcast")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan
