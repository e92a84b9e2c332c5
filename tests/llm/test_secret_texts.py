"""Secrets in raw texts, made by templates that the library doesn't know: what the scan finds and what it flags."""

import random
import string

import pytest

from vistaquad.llm import secrets, toxicity

ALNUM = string.ascii_letters + string.digits
HEX = "0123456789abcdef"


def drawn(rng, letters, low, high=None):
    while True:
        found = "".join(rng.choice(letters) for _ in range(rng.randint(low, high or low)))
        if any(c.isdigit() for c in found) and any(c.isalpha() for c in found):
            return found


def word_password(rng):
    return rng.choice(["Winter", "Dragon", "Blue", "correct", "Monday", "hunter"]) + str(rng.randint(10, 9999)) + rng.choice(["!", "#", "xyz", "_Q", "$k"])


#: (template, maker of the value)
SECRET = [
    ('db_pass = "{}"', word_password),
    ("DATABASE_URL=postgres://app:{}@db.internal:5432/shop", lambda r: drawn(r, ALNUM, 10, 16)),
    ("mongodb://root:{}@10.0.0.3/admin", word_password),
    ("sshpass -p {} ssh deploy@host", lambda r: drawn(r, ALNUM, 10, 14)),
    ("signing_key: {}", lambda r: drawn(r, ALNUM, 10, 24)),
    ("encryption_key={}==", lambda r: drawn(r, ALNUM + "+/", 22)),
    ("aws_secret_access_key = {}", lambda r: drawn(r, ALNUM + "+/", 40)),
    ('{{"clientSecret": "{}", "scope": "all"}}', lambda r: drawn(r, ALNUM + "-_", 32)),
    ("Authorization: Bearer {}", lambda r: drawn(r, ALNUM, 30, 48)),
    ("export GITHUB_TOKEN=ghp_{}", lambda r: drawn(r, ALNUM, 36)),
    ("curl --api-key {} https://api.service.io", lambda r: drawn(r, HEX, 32)),
    ("mysqldump --password {} shop > out.sql", word_password),
    ("webhook: https://hooks.chat.io/services/T{}", lambda r: drawn(r, string.ascii_uppercase + string.digits, 20)),
    ("the smtp password is now set, smtp_password: '{}'", word_password),
    ("session token => token = '{}'", lambda r: drawn(r, ALNUM, 24)),
    ("jwt: eyJhbGciOiJIUzI1NiJ9.{}.c2lnbmF0dXJlMTIzNDU2", lambda r: drawn(r, ALNUM, 40)),
    ("slack_token = xoxb-{}", lambda r: drawn(r, ALNUM, 24)),
    ("login with user root, passwd: {}", word_password),
    ("PRIVATE-KEY = {}", lambda r: drawn(r, ALNUM + "+/", 44)),
    ("credential={}", lambda r: drawn(r, ALNUM, 18)),
]
OTHER = [
    ("Merge commit {} into main", lambda r: drawn(r, HEX, 40)),
    ("sha256 checksum {}", lambda r: drawn(r, HEX, 64)),
    ("md5: {} dump.tar", lambda r: drawn(r, HEX, 32)),
    ("trace id {} took 12 ms", lambda r: "-".join(drawn(r, HEX, n) for n in (8, 4, 4, 4, 12))),
    ("GET /assets/js/vendor-chunk-{}.js 200", lambda r: drawn(r, string.digits + "ab", 4)),
    ("Opened quarterly_report_{}_final_version.docx", lambda r: str(r.randint(2001, 2030))),
    ("password: <your password goes here> {}", lambda r: r.choice(["1", "2"])),
    ("api_key = 'your_api_key_here_{}'", lambda r: str(r.randint(1, 9))),
    ("token = 'xxxxxxxxxxxxxxxx{}'", lambda r: str(r.randint(0, 9))),
    ("secret: example_secret_value_{}", lambda r: str(r.randint(100, 999))),
    ("call 0044{} after nine", lambda r: "".join(r.choice(string.digits) for _ in range(14))),
    ("invoice 2024-{}-0001-77 was paid", lambda r: "".join(r.choice(string.digits) for _ in range(12))),
    ("the DefaultHttpMessageConverterFactory{} class", lambda r: str(r.randint(1, 9))),
    ("chapter-12-section-{}-summary-notes", lambda r: str(r.randint(1, 99))),
    ("2024-03-05T10:11:12Z request {} done", lambda r: "".join(r.choice(string.digits) for _ in range(17))),
    ("IBAN DE89 370400440532013{}", lambda r: "".join(r.choice(string.digits) for _ in range(3))),
    ("etag: {}", lambda r: drawn(r, HEX, 32)),
    ("uuid={}", lambda r: "-".join(drawn(r, HEX, n) for n in (8, 4, 4, 4, 12))),
    ("see https://www.site.org/articles/2023/11/how-to-bake-{}-breads", lambda r: str(r.randint(2, 9))),
    ("order no {} shipped by truck", lambda r: "".join(r.choice(string.digits) for _ in range(18))),
    ("password = os.environ['DB_PASS_{}']", lambda r: str(r.randint(1, 3))),
    ("image layer_background_large_{}x was saved", lambda r: str(r.randint(1, 4))),
    ("revision {} of the manual", lambda r: drawn(r, HEX, 20)),
    ("version 1.2.{} build 20240305101112345", lambda r: str(r.randint(0, 9))),
    ("She walked {} miles and talked about the weather all day", lambda r: str(r.randint(2, 30))),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(11)
    rows = []
    for kind, templates, n in ((1, SECRET, 6), (0, OTHER, 10)):
        for template, value in templates:
            for _ in range(n):
                v = value(rng)
                rows.append((len(rows), "Some words before. " + template.format(v) + " and after.", kind, v))
    forest = secrets.fit_secrets(secrets.labelled_findings(spark))
    found: dict = {}
    for r in secrets.secrets(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), forest).collect():
        found.setdefault(r.id, []).append((r.candidate, r.score))
    return rows, found


def test_recall_and_precision_on_raw_texts(scanned):
    rows, found = scanned
    secret, other = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    assert len(secret) >= 100 and len(other) >= 200
    there = [any(v in c or (len(c) >= 6 and c in v) for c, _ in found.get(i, [])) for i, _, _, v in secret]
    caught = [any(s >= 0.5 and (v in c or (len(c) >= 6 and c in v)) for c, s in found.get(i, [])) for i, _, _, v in secret]
    flagged = [any(s >= 0.5 for _, s in found.get(i, [])) for i, _, _, _ in other]
    recall, precision = sum(caught) / len(secret), sum(caught) / max(1, sum(caught) + sum(flagged))
    print(f"candidates {sum(there) / len(secret):.3f}, recall {recall:.3f}, precision {precision:.3f}")
    missed = sorted({t for (_, t, _, _), c in zip(secret, caught, strict=True) if not c})
    wrong = sorted({t for (_, t, _, _), f in zip(other, flagged, strict=True) if f})
    assert sum(there) / len(secret) >= 0.97 and recall >= 0.9 and precision >= 0.85, (missed, wrong)


@pytest.mark.parametrize("text, want", [('db_pass = "hunter2xyz"', "hunter2xyz"), ("postgres://app:S3cr9tPw@db", "S3cr9tPw"), ("sshpass -p Qz7kLm2pXw ssh x", "Qz7kLm2pXw"), ("signing_key: Zx9Kq3LmPw", "Zx9Kq3LmPw"), ("encryption_key=QmVhdXRpZnVsMTIzNDU2Nzg5MA==", "QmVhdXRpZnVsMTIzNDU2Nzg5MA=="), ("x eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK y", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK")])
def test_candidates_in_every_form(spark, text, want):
    assert [r.candidate for r in secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [want]


def test_every_name_that_the_forest_learns_makes_candidates(spark):
    texts = [f'{name} = "Zq7pWm2k"' for name in secrets._SECRET_NAMES if name != "sshpass"]
    found = secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id for r in found if r.candidate == "Zq7pWm2k"} == set(range(len(texts)))


def test_patterns_of_words_take_the_longest():
    import re

    words = ["in", "inside", "insider", "so", "some", "me"]
    assert re.sub(secrets.pattern_of(words), "-", "insiderinsidexinsosome") == "--x---"
    assert len(secrets.dictionary()) == secrets.DICTIONARY and all(w.isalpha() and len(w) >= 4 for w in secrets.dictionary())


def test_a_labelled_id_that_thousands_of_rows_share(spark):
    docs = spark.createDataFrame([(7, f"text {i % 40}") for i in range(5000)] + [(8, "other"), (9, None)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1), (7, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, "toxic", 10).collect()
    again = toxicity.labelled(docs.repartition(3), labels, "toxic", 10).collect()
    assert len(rows) == len({r.id for r in rows}) <= 3 and sorted(map(tuple, rows)) == sorted(map(tuple, again))
