"""Operators that other queries show on literal rows, over whole tables against brute force."""

import re

from tallyloom.plans import texts, usage
from tallyloom.session import read_table


def test_session_groups(spark, small):
    links = [(r.id, r.parent_id) for r in read_table(spark, small, "agent_session").collect() if r.id is not None]
    group = {i: i for i, _ in links}
    for _ in links:
        for i, p in links:
            if p in group:
                group[i] = group[p] = min(group[i], group[p])
    got = {r.node: r.grp for r in usage.session_groups(spark, small).collect()}
    assert got == group and 1 < len(set(group.values())) < len(group)


def test_texts_glossary(spark, small):
    library = {"heat sink": "散热器", "lane": "通道", "clock tree": "时钟树", "sink": "汇"}
    docs = read_table(spark, small, "documents").where("text is not null").collect()
    want = {(d.doc_id, k, t) for d in docs for k, t in library.items() if re.search(rf"(?<![a-z0-9]){k}(?![a-z0-9])", d.text.lower())}
    assert want and {(r.doc_id, r.key, r.target) for r in texts.texts_glossary(spark, small).collect()} == want
