import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm.exact import decode_filter, drop_exact_duplicates, encode_filter, exact_duplicates, merge_filters


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**60 - 1), min_size=1, max_size=60), st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_filters_lose_nothing(wide, narrow):
    blocks, want = [], defaultdict(int)
    for part in (wide, narrow, narrow[:3]):
        values, counts = np.unique(np.array(part, np.uint64) | np.uint64(5 << 60), return_counts=True)
        blocks.append(encode_filter(values, counts, 4))
        got = decode_filter(blocks[-1], 5, 4)
        assert (got[0] == values).all() and (got[1] == counts).all()
        for v, c in zip(values.tolist(), counts.tolist()):
            want[v] += c
    merged = merge_filters(blocks, 5, 4)
    values, counts = decode_filter(merged, 5, 4)
    assert merged == encode_filter(values, counts, 4) == merge_filters(blocks[::-1], 5, 4)
    assert (np.diff(values) > 0).all()
    assert dict(zip(values.tolist(), counts.tolist())) == want


def test_against_plain_grouping(docs, odd_rows):
    rows = odd_rows + [(100 + i, f"text {i % 7}") for i in range(60)]
    got = exact_duplicates(docs(rows, 3)).collect()
    assert len(got) == len(rows)
    members = defaultdict(list)
    for i, t in rows:
        members[norm(t)].append(i)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by_sha = {sha(t): ids for t, ids in members.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(by_sha)


def test_drop_keeps_all_columns(docs, odd_rows):
    table = docs(odd_rows)
    kept = drop_exact_duplicates(table)
    assert kept.columns == table.columns
    assert kept.count() == len({norm(t) for _, t in odd_rows})


def test_empty(docs):
    assert exact_duplicates(docs([])).count() == 0
    assert drop_exact_duplicates(docs([])).count() == 0
