from collections import Counter

from tableloom.operators import nesting as N
from tableloom.operators import skew


def whole(nested):
    """Every element of every key, with its multiplicity."""
    out = {}
    for row in nested.all_parts().collect():
        out.setdefault(tuple(row[k] for k in nested.keys), Counter()).update(tuple(x) for x in row[nested.name])
    return out


def test_small_groups_make_one_row_each(frame):
    child = frame([(1, 3, "c"), (1, 1, "a"), (2, 9, "z"), (None, 5, "n")], "k int, n int, v string")
    got = N.collect_children(child, ["k"], "items", ["v", "n"], ["n"])
    assert got.continuations is None
    rows = {r["k"]: [tuple(x) for x in r["items"]] for r in got.rows.collect()}
    assert rows == {1: [("a", 1), ("c", 3)], 2: [("z", 9)]}


def test_heavy_key_is_split_and_nothing_is_lost(frame):
    child = frame([(1, i, "x") for i in range(500)] + [(2, 1, "y")], "k int, n int, v string")
    got = N.collect_children(child, ["k"], "items", max_items=64)
    rows = got.rows.collect()
    assert sorted(r["k"] for r in rows) == [1, 2]
    parts = got.continuations.collect()
    assert len(parts) >= 5 and {r["k"] for r in parts} == {1}
    assert max(len(r["items"]) for r in [*rows, *parts]) <= 128
    for r in [*rows, *parts]:
        assert list(r["items"]) == sorted(r["items"])
    assert whole(got)[(1,)] == Counter((i, "x") for i in range(500))
    assert whole(got)[(2,)] == Counter({(1, "y"): 1})


def test_heavy_group_of_copies_is_split_too(frame):
    child = frame([(1, 7, "same")] * 1000 + [(1, 8, "other")], "k int, n int, v string")
    got = N.collect_children(child, ["k"], "items", max_items=64)
    assert whole(got)[(1,)] == Counter({(7, "same"): 1000, (8, "other"): 1})
    assert max(len(r["items"]) for r in got.all_parts().collect()) < 400


def test_more_heavy_keys_than_a_broadcast_takes(frame, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 2)
    child = frame([(k, i) for k in range(6) for i in range(40)], "k int, n int")
    hot = skew.hot_keys(child, ["k"], 16, limit=2)
    assert not hot.small and not hot.empty
    got = N.collect_children(child, ["k"], "items", max_items=16, hot=hot)
    assert whole(got) == {(k,): Counter((i,) for i in range(40)) for k in range(6)}


def test_parents_without_children_keep_an_empty_array(frame):
    parent = frame([(1, "p"), (2, "q")], "id int, name string")
    child = frame([(1, 5), (1, 4)], "owner int, n int")
    got = N.include_many(parent, child, {"id": "owner"}, "items")
    rows = {r["name"]: [x["n"] for x in r["items"]] for r in got.rows.collect()}
    assert rows == {"p": [4, 5], "q": []}
    inner = N.include_many(parent, child, {"id": "owner"}, "items", keep_all=False)
    assert [r["name"] for r in inner.rows.collect()] == ["p"]


def test_branches_do_not_multiply(frame):
    parent = frame([(1,)], "id int")
    a = frame([(1, i) for i in range(4)], "ak int, a int")
    b = frame([(1, i) for i in range(3)], "bk int, b int")
    both = N.include_branches(parent, [(a, {"id": "ak"}, "as", None, None), (b, {"id": "bk"}, "bs", None, None)])
    row = both[-1].rows.collect()[0]
    assert (len(row["as"]), len(row["bs"])) == (4, 3)


def test_link_table_from_both_sides(frame):
    items = frame([(1, "i1"), (2, "i2"), (3, "i3")], "item int, item_name string")
    groups = frame([(10, "g1"), (20, "g2")], "grp int, grp_name string")
    link = frame([(1, 10), (1, 20), (2, 10)], "li int, lg int")
    left = N.include_through_link(items, link, groups, {"item": "li"}, {"grp": "lg"}, "groups", ["grp_name"]).rows
    assert {r["item"]: [x[0] for x in r["groups"]] for r in left.collect()} == {1: ["g1", "g2"], 2: ["g1"], 3: []}
    right = N.include_through_link(groups, link, items, {"grp": "lg"}, {"item": "li"}, "items", ["item_name"]).rows
    assert {r["grp"]: [x[0] for x in r["items"]] for r in right.collect()} == {10: ["i1", "i2"], 20: ["i1"]}


def test_parts_of_keys_without_a_parent_are_left_out(frame):
    parent = frame([(1,)], "k int")
    child = frame([(1, i) for i in range(20)] + [(2, i) for i in range(40)], "k int, v int")
    got = N.include_many(parent, child, {"k": "k"}, "items", max_items=8)
    assert sorted((r["k"], r["v"]) for r in got.exploded().collect()) == [(1, i) for i in range(20)]


def test_heavy_arrays_are_made_once(frame):
    child = frame([(k, i) for i in range(120) for k in range(3)], "k int, v int")
    got = N.collect_children(child, ["k"], "items", max_items=16, hot=skew.hot_keys(child, ["k"], 16, limit=1))
    # The leading part, the first parts and the rest read what was written.
    assert "collect_list" not in got.continuations._jdf.queryExecution().optimizedPlan().toString()
    assert whole(got) == {(k,): Counter((i,) for i in range(120)) for k in range(3)}
