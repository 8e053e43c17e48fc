"""Nested action trees to rows: containers before children, branches in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Properties that hold child actions, in the order they run.
BRANCHES = ("body", "then", "elseIf", "else", "finally")


def flatten_actions(df: DataFrame, json_col: str, keys: Sequence[str], branches: Sequence[str] = BRANCHES) -> DataFrame:
    """Rows (keys, ord, action_path, kind, expr, is_container) of a column of JSON action lists.

    Spark has no recursive type, so the walk over one document runs in an Arrow batch
    function; documents are spread as Spark partitions them and nothing is shuffled. A document that is no list of
    objects gives one row of kind ``malformed`` with the reason and no path; a null or empty one gives no row.
    """
    names = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)
    order = tuple(branches)

    def walk(batches):
        import json

        import pandas as pd

        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                start = len(rows)
                try:
                    tree = json.loads(rec[json_col] or "[]")
                    if not isinstance(tree, list):
                        raise ValueError("not a list of actions")
                    todo = [((i,), node) for i, node in reversed(list(enumerate(tree)))]
                except ValueError as e:
                    rows.append([*(rec[k] for k in names), 0, [], "malformed", str(e), False])
                    continue
                n = 0
                while todo:
                    path, node = todo.pop()
                    if not isinstance(node, dict) or any(not isinstance(node.get(b, []), list) for b in order):
                        del rows[start:]
                        rows.append([*(rec[k] for k in names), 0, [], "malformed", f"no action at {'.'.join(map(str, path))}", False])
                        break
                    children = [c for b in order for c in node.get(b, [])]
                    rows.append([*(rec[k] for k in names), n, list(path), node.get("kind"), node.get("expr"), any(b in node for b in order)])
                    n += 1
                    todo.extend(((*path, i), c) for i, c in reversed(list(enumerate(children))))
            yield pd.DataFrame(rows, columns=[*names, "ord", "action_path", "kind", "expr", "is_container"])

    return df.select(*names, json_col).mapInPandas(walk, f"{fields}, ord int, action_path array<int>, kind string, expr string, is_container boolean")
