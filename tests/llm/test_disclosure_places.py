"""Disclosing terms far from the entity."""

import random

from geoweave.llm import privacy
from tests.llm.conftest import documents


def test_disclosing_terms_go_everywhere_in_the_text(spark):
    r = random.Random(8)
    fill = lambda: " ".join(r.choice(("river", "stone", "green", "after", "window", "market")) for _ in range(30))
    rows = [(i, f"{fill()} Zelmira wrote from zel@host.example about {fill()}" + (f" zelmira {fill()}" if i == 0 else ""), "a") for i in range(8)]
    rows += [(20, f"Zelmira left. {fill()} zel@host.example", "a"), (21, f"{fill()} other@host.example", "a")] + [(50 + i, fill(), "a") for i in range(60)]
    got = {x.doc_id: x for x in privacy.sanitise(documents(spark, rows)).collect()}
    for i in (*range(8), 20):
        assert "zelmira" not in got[i].sanitised.lower() and "[EMAIL]" in got[i].sanitised and "river" in got[i].sanitised
    assert all(not [s for s in got[i].spans if s.kind in ("general", "removed")] for i in (21, *range(50, 110)))
