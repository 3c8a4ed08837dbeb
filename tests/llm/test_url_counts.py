"""URL scores against n-gram counts kept in dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np

from orbivec.llm import urls


def test_scores_follow_exact_counts(spark):
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789-_"))
    paths = ["".join(rng.choice(letters, 20)) for _ in range(6000)]
    rows = [(n, f"http://x.{('com', 'net', 'org')[n % 3]}/{p}") for n, p in enumerate(paths)] + [(-1, None), (6000, "http://x.com/é")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "com/"), ("block", "net/")]).collect()}
    assert len(got) == len(rows)

    marked = {n: b"\x02" + (u or "").removeprefix("http://").encode() + b"\x03" for n, u in rows}
    seen = {"allow": Counter(), "block": Counter()}
    for n, t in marked.items():
        said = "allow" if b"x.com/" in t else "block" if b"x.net/" in t else None
        if said and zlib.crc32(str(n).encode()) % 5:
            seen[said].update(t[i - k:i + 1] for i in range(len(t)) for k in range(min(i, 5) + 1))
    for n in [*range(2, 300, 3), -1, 6000]:
        t, want = marked[n], 0.0
        for said, sign in (("allow", 1), ("block", -1)):
            every = sum(c for g, c in seen[said].items() if len(g) == 1)
            for i in range(1, len(t)):
                p = 1 / 256
                for k in range(min(i, 5) + 1):
                    context = seen[said][t[i - k:i]] if k else every
                    p = (min(seen[said][t[i - k:i + 1]], context) + 2 * p) / (context + 2)
                want += sign * math.log(p)
        assert abs(got[n].score - want / (len(t) - 1)) < 1e-9
