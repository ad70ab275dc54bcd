"""DuckDB SQL for the Merkle manifest's rows, level by level."""

from __future__ import annotations

#: Levels that the SQL unrolls: trees of up to 16 ** LEVELS leaves.
LEVELS = 5


def _field(c: str) -> str:
    return f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _level(name: str, source: str) -> str:
    run = "partition by tree, k // 16 order by k rows between"
    sides = f"coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r"
    return f"{name} as (select tree, k, h, count(*) over (partition by tree) as n, {sides} from ({source}) s)"


def _tree(name: str, leaves: str) -> str:
    """Views ``name``0, ``name``1, ... of the nodes by level, and ``name``_top with the root of each tree."""
    views = [_level(f"{name}0", leaves)]
    for j in range(LEVELS):
        views.append(_level(f"{name}{j + 1}", f"select tree, k // 16 as k, sha256(string_agg(h, '' order by k)) as h from {name}{j} where n > 1 group by tree, k // 16"))
    tops = " union all ".join(f"select tree, h from {name}{j} where n = 1" for j in range(LEVELS + 1))
    return ",\n".join([*views, f"{name}_top as ({tops})"])


def _path(name: str, tree: str, k: str, node: str, source: str) -> str:
    """``source`` with ``node`` folded up the tree and the siblings met on the way added to proof."""
    out = source
    for j in range(LEVELS):
        on = f"{name}{j}.tree is not distinct from s.{tree} and {name}{j}.k = s.{k} // {16**j} and {name}{j}.n > 1"
        out = f"select s.* exclude ({node}, proof), case when {name}{j}.n > 1 then sha256(l || {node} || r) else {node} end as {node}, proof || coalesce(l || r, '') as proof from ({out}) s left join {name}{j} on {on}"
    return out


_CRC = """xor(4294967295, list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, (c & 1) * 3988292384) end))"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
with hashed as (select doc_id, source, {_leaf("text")} as leaf, case when {_CRC} % 5 = 0 then {_leaf(_LOWER)} end as changed from documents),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as k from hashed),
{_tree("a", "select source as tree, k, leaf as h from placed")},
ranked as (select tree as source, h as subroot, row_number() over (order by tree nulls first) - 1 as sk from a_top),
{_tree("b", "select 0 as tree, sk as k, subroot as h from ranked")},
begun as (select doc_id, leaf, p.source, k, sk, 0 as whole, subroot, coalesce(changed, leaf) as node, '' as proof from placed p join ranked t on p.source is not distinct from t.source),
inside as ({_path("a", "source", "k", "node", "select * from begun")}),
beyond as ({_path("b", "whole", "sk", "node", "select * from inside")})
select doc_id, leaf, subroot, b_top.h as root, sha256(proof) as proof_sha256, node as folded_root, node = b_top.h as verified from beyond cross join b_top"""
