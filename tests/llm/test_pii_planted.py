"""Recall on personal data planted in real documents, written apart from the sentences the field is trained on."""

import random

import pytest

from weftmark.llm import pii

GIVEN = "Alice Bob Carla Dmitri Eleni Farid Greta Hassan Ingrid João Keiko Lars Mei Nadia Olga Pedro".split()
FAMILY = "Abbott Bianchi Costa Dubois Eriksen Fischer García Hughes Ivanova Jansen Kowalski Lindqvist Moreau Novak Okafor Petrov".split()
STREETS = ("Maple Street", "High Street", "Elm Grove Road", "Station Road", "Park Avenue", "Church Lane", "Riverside Drive", "Kings Court")
FOREIGN = ("Hauptstraße {n}", "Goethestraße {n}", "Lindenallee {n}", "{n} rue de Rivoli", "{n} avenue Victor Hugo", "Calle Mayor {n}", "Avenida América {n}")
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def with_check(body):
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def planted(r):
    """(kind, sentence with {} for the entity, entity): formats in common use, one of each per call."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    nz = lambda: r.choice("123456789")
    mix = lambda n, signs=ALNUM: "".join(r.choice(signs) for _ in range(n))
    who = f"{r.choice(GIVEN)} {r.choice(FAMILY)}"
    mail = f"{r.choice(GIVEN).lower().replace('ã', 'a')}_{r.choice(FAMILY).lower().replace('í', 'i')}@{r.choice(['corp', 'mail', 'univ'])}.{r.choice(['example', 'test'])}.{r.choice(['org', 'net', 'de'])}"
    amex = with_check("37" + d(12))
    visa = with_check("4" + d(14))
    group = lambda s, sizes, by: by.join(s[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    month = r.choice(["January", "April", "August", "November"])
    iban_body = d(18)
    iban = f"DE{98 - int(iban_body + '131400') % 97:02d}{iban_body}"
    return [
        ("email", "You can reach me under {} any day", mail),
        ("email", "From: <{}>", mail),
        ("ip", "login attempt from {} failed", f"{r.randint(1, 223)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}"),
        ("card", "paid with {} yesterday", visa),
        ("card", "my Visa is {}, please charge it", group(visa, (4, 4, 4, 4), " ")),
        ("card", "Amex {} expires soon", group(amex, (4, 6, 5), "-")),
        ("phone", "please ring me on {} after six", f"+44 20 {d(4)} {d(4)}"),
        ("phone", "Tel.: {}", f"+49 (0)30 {nz()}{d(6)}"),
        ("phone", "his cell {} is off", f"({nz()}{d(2)}) {nz()}{d(2)}-{d(4)}"),
        ("phone", "téléphone : {}", f"0{r.choice('16')} {d(2)} {d(2)} {d(2)} {d(2)}"),
        ("phone", "call {} for help", f"{nz()}{d(2)}.{nz()}{d(2)}.{d(4)}"),
        ("ssn", "her social security number {} leaked", f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        ("iban", "transfer it to {} today", iban),
        ("iban", "Konto {} bei der Bank", group(iban, (4, 4, 4, 4, 4, 2), " ")),
        ("secret", "export AWS_ACCESS_KEY_ID={}", "AKIA" + mix(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")),
        ("secret", 'aws_secret_access_key = "{}"', mix(39) + "7"),
        ("secret", "git clone with token {} works", "ghp_" + mix(35) + "3"),
        ("secret", '"api_key": "{}",', mix(32, "0123456789abcdef")),
        ("secret", "Authorization: Bearer {}", f"eyJ{mix(30)}1.eyJ{mix(40)}.{mix(20)}"),
        ("secret", "client_secret: {}", mix(24) + "-" + mix(10) + "9"),
        ("secret", "DB_PASSWORD='{}'", r.choice(GIVEN) + "#" + d(4) + mix(4)),
        ("birth", "date of birth: {}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1940, 2010)}"),
        ("birth", "she was born on {} in a village", f"{r.randint(1, 28)} {month} {r.randint(1940, 2010)}"),
        ("birth", "DOB: {}", f"{r.randint(1940, 2010)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"),
        ("birth", "geboren am {} als Kind", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1940, 2010)}"),
        ("name", "we spoke with Mr. {} about it", who),
        ("name", "full name: {}", who),
        ("name", "Frau {} rief gestern an", who),
        ("address", "he lives at {} with his sister", f"{r.randint(1, 250)} {r.choice(STREETS)}"),
        ("address", "shipping address: {}", f"{r.randint(1, 250)} {r.choice(STREETS)}"),
        ("address", "she moved to {} last year", r.choice(FOREIGN).format(n=r.randint(1, 120))),
        ("document", "passport number {} was stolen", mix(2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + d(7)),
        ("document", "his driver's license {} expired", mix(1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + d(7)),
    ]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 200 and 4000").select("doc_id", "text").collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_recall_on_planted_entities(texts):
    weights, r, found, total = pii.train(), random.Random(2024), {}, {}
    for _ in range(30):
        for kind, sentence, entity in planted(r):
            text, at = r.choice(texts), r.random()
            cut = text.find(" ", int(at * len(text)))
            cut = len(text) if cut < 0 else cut
            before = text[:cut] + " " + sentence[: sentence.index("{}")]
            whole = before + entity + sentence[sentence.index("{}") + 2 :] + text[cut:]
            span = (kind, len(before), len(before) + len(entity))
            total[kind] = total.get(kind, 0) + 1
            found[kind] = found.get(kind, 0) + (span in pii.all_spans(whole, weights)[1])
    recall = {kind: found[kind] / total[kind] for kind in total}
    print(recall, sum(found.values()) / sum(total.values()))
    assert sum(found.values()) >= 0.9 * sum(total.values()), recall
    assert min(recall.values()) >= 0.75, recall


def test_documents_without_personal_data_are_left_alone(texts):
    weights = pii.train()
    clean = [t for t in texts if "token" not in t and not pii.base_spans(t)]
    hit = [(t[s:e], kind) for t in clean for kind, s, e in pii.all_spans(t, weights)[1]]
    assert len(clean) > 50 and len(hit) <= len(clean) // 100, hit
