"""What the review of round 1 found missing, on small cases."""

import pytest

from riskledger.llm import line_dedup, pii
from tests.llm.test_operators import docs, words


@pytest.mark.parametrize("offset", range(1, 9))
def test_line_dedup_finds_runs_at_any_offset(spark, offset):
    run = words(50, 900).split()
    flow = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    own = lambda n, name: " ".join(f"{name}{i}" for i in range(n))
    changed = [*run[:offset], "inserted", *run, "end"]
    texts = [f"{own(offset, 'a')} {' '.join(run)} {own(20, 'b')}", f"{own(3, 'c')} {' '.join(run)}\n{own(4, 'd')}", flow(run, 7), f"{own(2, 'e')} {' '.join(changed)}"]
    got = {x.doc_id: (x.text, x.removed_words) for x in line_dedup.deduplicate_lines(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 0) and got[2] == ("", 50)
    assert got[1] == (f"{own(3, 'c')}\n{own(4, 'd')}", 50)
    assert got[3] == (f"{own(2, 'e')} {' '.join(run[:offset])} inserted end", 50)


def test_neighbouring_numbers_and_quoted_secrets_get_pseudonyms(spark):
    ssn, secret = "123-45-6789", "0a1b2c3d" * 5
    cases = [(f"{ssn} 987-65-4321", [ssn], "987-65-4321"), (f"{ssn} 555-123-4567", [ssn, "555-123-4567"], ""), (f'token = "{secret}"', [secret], "token = "), (f'TOKEN = "{secret}"', [secret], "TOKEN = ")]
    got = {x.doc_id: x.text for x in pii.pseudonymise(docs(spark, [*[c for c, _, _ in cases], "token = tokenizer(x)"]), key="k").collect()}
    for i, (text, gone, kept) in enumerate(cases):
        assert len(got[i]) == len(text) and kept in got[i] and not any(g in got[i] for g in gone)
    assert got[len(cases)] == "token = tokenizer(x)"
