"""The secret scan on forms that its generator does not know."""

import random

import pyarrow as pa
import pytest
from secret_forms import HARMLESS, SECRETS, TEXT, around

from lumenfold.llm import secrets


@pytest.fixture(scope="module")
def field(spark):
    r = random.Random(31)
    words = [*TEXT, "Price", "42", "2021", "(about)", "north-east", "e.g.", "item", "no.", "7", "said:", "it's"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(30, 120))) for _ in range(1500)]
    texts += [f"{t} password: {r.getrandbits(80):x}kZ and more" for t in texts[:100]]
    return secrets.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def spans(field, texts):
    return secrets.scan(pa.array(texts, pa.large_string()), field)


def test_secrets_of_forms_that_were_not_learned(field):
    r, exact, n = random.Random(32), {}, 150
    for name, form in SECRETS.items():
        texts, wanted = [], []
        for _ in range(n):
            before, own, after = form(r)
            text, at = around(r, before + own + after)
            texts.append(text)
            wanted.append((at + len(before), at + len(before) + len(own)))
        exact[name] = sum(any((s[3], s[2]) == w for s in found) for found, w in zip(spans(field, texts), wanted)) / n
    assert sum(exact.values()) / len(exact) >= 0.9 and min(exact.values()) >= 0.2, exact


def test_harmless_look_alikes_stay(field):
    r, flagged, n = random.Random(33), {}, 300
    for name, form in HARMLESS.items():
        texts = [around(r, form(r))[0] for _ in range(n)]
        flagged[name] = sum(any(s[1] == "crf" for s in found) for found in spans(field, texts)) / n
    assert sum(flagged.values()) / len(flagged) <= 0.015 and max(flagged.values()) <= 0.08, flagged


def test_code_is_left_whole(field):
    code = """
    public class RemoteCacheEntryV2Builder extends AbstractHashTable64<String> {
        private static final int MAX_RETRY_COUNT_3 = 12;
        def getHttp2ResponseCodeFor(self, statusLine1, bodyText2): return parseUtf8Header(statusLine1)[0]
        let el=document.querySelectorAll('.nav-item3');for(var i0=0;i0<el.length;i0++){el[i0].onClick2=handleItemClickEvent;}
        SELECT o_orderkey1, sum(l_extendedprice2) FROM lineitem3x GROUP BY 1 HAVING count(*) > 10;
    """
    assert [s for s in spans(field, [code])[0] if s[1] == "crf"] == []


def test_dotted_tokens_and_sentence_ends(field):
    token = "eyJhbGciOiJIUzI1NiIs9.eyJzdWIiOiIxMjM0NTY3ODkwIn0x7Kq2.SflKxwRJSMeKKF2QT4fwpMeJf36"
    text = f"Authorization: Bearer {token} was sent. It ended with Bearer {token}."
    found = [(s[3], s[2]) for s in spans(field, [text])[0] if s[1] == "crf"]
    assert found == [(text.index(token), text.index(token) + len(token)), (text.rindex(token), text.rindex(token) + len(token))]
