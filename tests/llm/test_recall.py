"""What the two detectors add, on sentences and forms that are not those of their lessons."""

from __future__ import annotations

import json
import random

import numpy as np

from inkwell.llm import pii, secrets, spans

PROSE = (
    "The committee will meet again on Thursday to settle the remaining points of the budget.",
    "Please bring the signed form with you, otherwise the desk cannot hand over the parcel.",
    "Wir treffen uns am Freitag vor dem Rathaus und gehen dann gemeinsam zum Bahnhof.",
    "La reunión empieza a las nueve y termina antes de comer, según el programa.",
    "Nous avons reçu votre dossier et nous vous répondrons avant la fin du mois.",
    "She moved the old piano into the hall because the new owners wanted the room.",
)


def card(rng: random.Random) -> str:
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if spans.luhn(d + c))


def personal_forms(rng: random.Random) -> list[tuple[str, str]]:
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = rng.choice(["jane.doe", "max_muster", "p.garcia", "lucie-martin", "o.svensson77"])
    host = rng.choice(["example.com", "firma.de", "correo.example.es", "mail.example.org", "univ.example.fr"])
    c = card(rng)
    return [
        ("email", f"{name} (at) {host}"), ("email", f"{name}[at]{host}"), ("email", f"{name} @ {host}"), ("email", f"{name}[@]{host}"), ("email", f"{name}(@){host}"),
        ("card", ".".join(c[i : i + 4] for i in range(0, 16, 4))),
        ("phone", f"({num(3)}) {num(3)}-{num(4)}"), ("phone", f"{num(3)}.{num(3)}.{num(4)}"), ("phone", f"{num(3)}-{num(3)}-{num(4)}"),
        ("phone", f"06 {num(2)} {num(2)} {num(2)} {num(2)}"), ("phone", f"6{num(2)} {num(3)} {num(3)}"), ("phone", f"030/{num(7)}"),
    ]


def test_recall_of_personal_data():
    rng, tagger = random.Random(31), pii.trained()
    texts, want = [], []
    for _ in range(40):
        for kind, piece in personal_forms(rng):
            a, b = rng.sample(PROSE, 2)
            lead = rng.choice(["", "Contact: ", "Call or write: ", "siehe ", "voir "])
            texts.append(f"{a} {lead}{piece}, {b}")
            want.append((kind, len(a) + 1 + len(lead), len(a) + 1 + len(lead) + len(piece)))
    found = [b + x for b, x in pii.find(texts, tagger)]
    exact = sum(w in f for w, f in zip(want, found)) / len(want)
    touched = sum(any(k == w[0] and s < w[2] and w[1] < e for k, s, e in f) for w, f in zip(want, found)) / len(want)
    by_form = [sum(w in f for w, f in zip(want[i::12], found[i::12])) / 40 for i in range(12)]
    print("personal data: exact", round(exact, 3), "touched", round(touched, 3), by_form)
    assert exact >= 0.9
    clean = [f"{a} In {rng.randint(1900, 2030)} there were {rng.randint(2, 99999)} of them, {rng.randint(1, 99)} % more; version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}. {b}" for _ in range(40) for a, b in [rng.sample(PROSE, 2)]]
    assert sum(map(bool, (x for _, x in pii.find(clean, tagger)))) <= 2


def secret_forms(rng: random.Random) -> list[str]:
    def key(n: int, alphabet: str = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    wide = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"
    pieces = [key(24), key(32), key(40, wide), f"{key(36, wide)}.{key(60, wide)}.{key(43, wide)}", key(20), key(28, "abcdefghijklmnopqrstuvwxyz0123456789"), f"ghp_{key(36)}", f"sk-{key(32)}"]
    forms = ["the private key is {}", "Authorization: Bearer {}", "client.credentials('user', '{}')", "use session {} to log in", "export SIGNING_KEY {}", "cookies: a=1; sid={}", "dbPassword -> {}", "passphrase '{}'"]
    return [(f.format(p), p) for f, p in zip(forms, rng.sample(pieces, len(pieces)))]


def test_recall_of_secrets():
    rng = random.Random(17)
    hit = total = 0
    for _ in range(60):
        for text, piece in secret_forms(rng):
            whole = f"{rng.choice(PROSE)}\n{text}\n{rng.choice(PROSE)}"
            base, added = secrets.find(whole)
            total += 1
            hit += any(whole[s:e] == piece or piece in whole[s:e] for _, s, e in base + added)
    print("secrets:", round(hit / total, 3))
    assert hit / total >= 0.9
    clean = ["Your password must have eight letters, say internationalization or responsibility.", "the token bucket algorithm: getUserAuthenticationHandlerFactory returns it", "Cookie policy: https://www.example.com/legal/privacy/cookie-policy/index.html", "key findings are in docs/reports/annual_report_final_version.pdf"]
    assert sum(len(secrets.find(t)[1]) for t in clean) == 0


def test_stored_weights_are_those_of_the_recipe():
    with open(pii.STORED, encoding="utf-8") as f:
        kept = json.load(f)
    assert kept["recipe"] == pii.recipe()
    own = pii.train().w
    assert own.keys() == kept["weights"].keys()
    assert all(np.allclose(own[k], np.array(w), atol=1e-2) for k, w in kept["weights"].items())
