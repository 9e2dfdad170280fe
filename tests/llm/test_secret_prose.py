"""Secret scans: prose stays as it is; generated texts of linked, too distant and partnerless parts agree with SQL and a plain version."""

import random

import brute
import duckdb
import pyarrow as pa

from gridstone.llm import secret_scan
from gridstone.llm.oracles import ORACLES

PROSE = [
    "Your password: required field. Help is at https://example.org/help",
    "The pass: through the mountains in winter. See http://alps.example/ for the map.",
    "His secret: patience. Source: https://example.net/interview?page=2",
    "The token: a small coin given at the door, see https://museum.example/coins#silver",
    "Password: Required. Login: please sign in at https://example.org/login first.",
    "Key points: the secret: nobody knows. User: the reader. Host: the museum.",
    "User: everyone. Password: forgotten. Server: down since Monday.",
    "Visit https://example.org/a and http://example.net/b?x=1&y=2 or ftp://files.example/pub",
    "The secret: thousand years of winter, account: closed, email: never answered.",
    "Private key: lost in 1999. Host: unknown. Account: 12345 was empty.",
    "pass: 123456 steps to the top; host: city hall; user: walkers",
    "A token: welcome drink. Endpoint: the station. Login: not needed.",
    "Secret: eternal youth, says https://blog.example/post?id=77&lang=en and nobody believes it.",
    "The password = swordfish in the old film; the hostname: Grand Hotel.",
    "uri: see above. url: see below. secret: hidden. user: visitor",
    "He wrote passphrase: something memorable, and the account_name: yours, on the board at https://school.example",
    "E-mail: write to us. Pwd: present working directory. Server: bring the plates.",
    "Token: Gestures. Secret: Recipes. Client_id: the number on your card.",
    "https://example.org/key=value/path?keyword=winter&monkey=1 is a page about the secret: bananas",
    "Le secret: patience. Hôte: le musée. Login: prénom. https://exemple.example/aide",
]


def generated(n=1000):
    rng = random.Random(12)
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    value = lambda k: "".join(rng.choice("abcXYZ0189") for _ in range(k))
    makers = [
        lambda: f"password={value(rng.randrange(3, 16))}", lambda: f'"secret": "{value(8)}"', lambda: "AKIA" + value(rng.randrange(12, 20)).upper(), lambda: hexa(rng.randrange(10, 24)),
        lambda: f"login: {value(4)}", lambda: f"username='{value(2)}'", lambda: value(40), lambda: value(39), lambda: value(40) + "=", lambda: f"hostname={value(5)}.example", lambda: f"endpoint: {value(3)}",
        lambda: f"user={value(5)}", lambda: f"AWS_ACCESS_KEY_ID={value(9)}", lambda: f"SECRET_ACCESS_KEY={value(40)}", lambda: f"pwd: {value(7)}", lambda: f"pass: {rng.choice(['through', '123456', 'hunter2'])}",
        lambda: f"host={value(4)}", lambda: f"url: https://{value(4)}.example/x", lambda: f"https://{value(4)}.example:8080/p?token={value(7)}", lambda: f"see http://{value(3)}/a?b=c",
        lambda: f"postgres://{value(4)}:{value(6)}@{value(4)}.example/db", lambda: f"http://{value(4)}@{value(5)}/", lambda: "password: required field", lambda: "secret: patience"]
    gaps = (" ", "\n", " ", " plain words between ", " é日本 ", " " + "x y " * 60, " " + "z " * 130)
    texts = ["".join(rng.choice(makers)() + rng.choice(gaps) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    return texts


def test_prose_is_left_alone(spark):
    frame = spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in secret_scan.redact(frame).collect()} == dict(enumerate(PROSE))
    assert all(r.spans == "" for r in secret_scan.scan(frame).collect())


def test_generated_texts_agree_with_a_plain_version_and_sql(spark):
    texts = generated()
    got = {r.doc_id: tuple(r)[1:] for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: brute.secrets(t) for i, t in enumerate(texts)}
    assert got == want
    seen = {s.split(":")[0] for w in want.values() for s in w[4].split(",")} - {""}
    assert seen == {k[0] for k in secret_scan.KINDS}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert {r[0]: tuple(r[1:]) for r in con.execute(ORACLES["op3_secret_scan"]).fetchall()} == want
