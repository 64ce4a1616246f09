"""Random strings between words of paths and addresses, without digits, and of 16 characters."""

import random
import string

from tessera.llm import secrets

LETTERS, BASE62 = string.ascii_letters, string.ascii_letters + string.digits
AROUND = ["", "download/public/documents/reports/annual/statements/archive/", "https://host.example.com/api/users/", "backup_key_for_production_service_"]


def share_found(alphabet, n, times=100):
    enc, r, hits = secrets.encoder(secrets.vocabulary(secrets.DEFAULT_VOCABULARY)), random.Random(n), 0
    for i in range(times):
        before, value = f"see {AROUND[i % 4]}", "".join(r.choice(alphabet) for _ in range(n))
        text = f"{before}{value} end"
        hits += any(a < len(before) + n and len(before) < b for a, b, _ in secrets.random_spans(text, [], enc))
    return hits / times


def test_words_of_a_path_do_not_hide_a_random_string():
    assert share_found(BASE62, 16) > 0.9 and share_found(BASE62, 20) > 0.9 and share_found(BASE62, 24) > 0.95
    assert share_found(LETTERS, 32) > 0.95 and share_found(string.ascii_lowercase, 32) > 0.95


def test_words_stay():
    enc = secrets.encoder(secrets.vocabulary(secrets.DEFAULT_VOCABULARY))
    for text in ("download/public/documents/reports/annual/statements/archive/", "/docs/guides/README", "nichtchzulichein Tiontionthlyrere", "the_quick_brown_fox_jumps_2024", "a key=" + "x9Qz7Lk2" * 3):
        assert secrets.random_spans(text, secrets.base_spans(text) + [(2, 30, "assign")] * ("key=" in text), enc) == []
