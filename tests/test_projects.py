"""Mapping projects: read as tables, checked, compiled to mapping trees, and documents as text."""

import json

import pytest

from tableloom.operators import documents as D
from tableloom.operators import projects as P
from tableloom.plans import structures as S


def with_names(mapping):
    """A hand-typed tree with the full names that a project gives to tables."""
    children = tuple(with_names(c) for c in mapping.children)
    return D.TableMapping(mapping.kind, f"{S.DATABASE}.{mapping.table}", mapping.fields, mapping.path, mapping.link, children)


@pytest.fixture
def read(frame):
    def run(text):
        return P.read_projects(frame([(text if isinstance(text, str) else json.dumps(text),)], "text string"), "text")

    return run


def test_project_gives_the_trees_written_by_hand(read):
    got = P.compile_project(read(S.project_text()))
    assert got == {"orders": with_names(S.ORDERS), "suppliers": with_names(S.SUPPLIERS)}


def test_null_flag_of_each_field_is_read(read):
    root = P.compile_project(read(S.null_flags(True)))["customers"]
    assert [f.null_excluded for f in root.fields] == [False, False, True]
    assert [f.null_excluded for f in root.children[0].fields] == [False, True]


def broken(change):
    project = json.loads(S.project_text())
    change(project, project["project"]["content"])
    return project


def circle(p, c):
    c["relationships"]["mappings"]["order-customer-tx"]["children"] = ["order-customer"]


def two_parents(p, c):
    c["relationships"]["mappings"]["supplier"]["children"].append("order-customer-tx")


def missing(p, c):
    c["relationships"]["mappings"]["supplier"]["children"].append("nowhere")


def orphan(p, c):
    c["relationships"]["mappings"]["order"]["children"] = []


def no_key(p, c):
    c["mappings"]["supplier-items"]["settings"]["foreignKeyName"] = "fk_other"


def wrong_key(p, c):
    c["mappings"]["supplier-items"]["settings"]["foreignKeyName"] = "fk_orders_customer"


def no_table(p, c):
    del c["tables"]["link"]


def doubled(p, c):
    c["mappings"]["supplier"]["fields"]["00"]["target"]["name"] = "supplierName"


def two_roots(p, c):
    c["mappings"]["supplier"]["collectionId"] = "orders"


@pytest.mark.parametrize(
    "change, word",
    [
        (circle, "circle"), (two_parents, "order-customer-tx: has several parents"), (missing, "nowhere: listed as a child but not described"),
        (orphan, "order-customer: embedded without a parent"), (no_key, "supplier-items: unknown foreign key"), (wrong_key, "does not join"),
        (no_table, "supplier-items: unknown table"), (doubled, "supplier: several fields named supplierName"), (two_roots, "orders: several roots"),
    ],
)
def test_projects_that_name_no_tree(read, change, word):
    with pytest.raises(P.ProjectError) as e:
        P.compile_project(read(broken(change)))
    assert any(word in p for p in e.value.problems), e.value.problems


def test_problems_of_many_projects_at_once(frame):
    texts = [(1, S.project_text()), (2, json.dumps(broken(orphan))), (3, json.dumps(broken(no_table))), (4, "{}"), (5, "no json"), (6, None)]
    project = P.read_projects(frame(texts, "id bigint, text string"), "text", ["id"])
    got = {(r.id, r.mapping_id, r.problem) for r in P.project_problems(project).collect()}
    assert got == {(2, "order-customer", "embedded without a parent"), (3, "supplier-items", "unknown table")}


def test_keys_of_several_columns(read, frame):
    fields = (D.Field("a", "a", "LONG", primary_key=True), D.Field("b", "b", "LONG", primary_key=True))
    part = (D.Field("n", "n", "LONG", primary_key=True),)
    mappings = {
        "top": ("tops", D.NEW_DOCUMENT, "top", None, None, fields, ["low"]),
        "low": ("tops", D.EMBEDDED_ARRAY, "low", "lows", "fk", part, ["one"]),
        "one": ("tops", D.EMBEDDED, "top", "one", "fk", fields, []),
    }
    keys = (("fk", "low", "x", "top", "a"), ("fk", "low", "y", "top", "b"))
    project = read(S.project_text(mappings, keys, ("tops",)))
    top = frame([(1, 1), (1, 2), (2, None)], "a bigint, b bigint")
    low = frame([(1, 2, 30), (1, 2, 10), (1, 1, 20), (2, None, 40), (None, 2, 50)], "x bigint, y bigint, n bigint")
    tables = {f"{S.DATABASE}.top": top, f"{S.DATABASE}.low": low}
    built = P.build_project(project, tables)["tops"]
    got = {(r.a, r.b): ([(x.n, (x.one.a, x.one.b)) for x in r.lows], r.lowsParts) for r in built.documents.collect()}
    assert got == {(1, 2): ([(10, (1, 2)), (30, (1, 2))], 1), (1, 1): ([(20, (1, 1))], 1), (2, None): ([], 1)}
    cut = P.build_project(project, tables, max_items=1)["tops"]
    rest = cut.continuations["lows"]
    assert set(rest.columns) >= {"x", "y", "part", "lows"} and {(r.x, r.y) for r in rest.collect()} == {(1, 2)}


def test_documents_as_text(frame):
    item = D.TableMapping(D.EMBEDDED_ARRAY, "i", (D.Field("k", "k", "LONG"), D.Field("v", "v", "STRING", null_excluded=True)), 'a"b', ("id", "id"))
    inner = D.TableMapping(D.EMBEDDED, "o", (D.Field("s", "s", "STRING", null_excluded=True), D.Field("d", "d", None)), "o", ("id", "id"), (item,))
    root = D.TableMapping(D.NEW_DOCUMENT, "r", (D.Field("id", "id", "LONG"), D.Field("no", "no", included=False), D.Field("t", "t", "STRING")), children=(inner,))
    schema = 'id bigint, t string, o struct<s: string, d: double, `a"bParts`: int, `a"b`: array<struct<k: bigint, v: string>>>'
    rows = [
        (1, 'q"\\\n', (None, 1.5, 1, [(1, None), (None, "x,")])),
        (2, None, ("s", None, 1, [])),
        (3, "t", None),
    ]
    docs = frame([(1,)], "x int").sparkSession.createDataFrame(rows, schema)
    got = [json.loads(r.d) for r in docs.select(P.document_text(root, generate_id=False).alias("d")).collect()]
    assert got == [
        {"id": 1, "t": 'q"\\\n', "o": {"d": 1.5, 'a"bParts': 1, 'a"b': [{"k": 1}, {"k": None, "v": "x,"}]}},
        {"id": 2, "t": None, "o": {"s": "s", "d": None, 'a"bParts': 1, 'a"b': []}},
        {"id": 3, "t": "t", "o": None},
    ]
