"""JSON texts as dotted paths, against a plain walk."""

import json

from loomline.sources import nested


def walk(x, path=""):
    if isinstance(x, dict):
        yield path, " ".join(sorted(x))
        for k, v in x.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(x, list):
        yield f"{path}.length" if path else "length", str(len(x))
        for k, v in enumerate(x):
            yield from walk(v, f"{path}.{k}" if path else str(k))
    else:
        yield path, None if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def test_paths(spark):
    values = [{"a": {"b": [1, 2.5, {"c": None}], "z": 't"x\né'}, "e": [], "o": {}}, [True, "x", [[]]], 7, "text", None, {"deep": {"er": {"and": {"deeper": [[[["end"]]]]}}}}]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(90, "nope{"), (91, None), (92, '{"a":1'), (93, ""), (7, json.dumps(values[0]))]
    got = list((r.id, r.path, r.value) for r in nested.flattened(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect())
    want = [(k, *x) for k, v in [*enumerate(values), (7, values[0])] for x in walk(v)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert nested.flattened(spark.createDataFrame([], "id long, j string"), "id", "j").collect() == []
