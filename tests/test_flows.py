"""Whole runs: metrics, partial scores, kept results, replies in steps, services and commands."""

import email.message
import io
import json
import urllib.error
from functools import partial

import numpy as np
import pytest

from lodestrata import commands
from lodestrata.constants import CATEGORY_QUERIES
from lodestrata.operators import flows
from lodestrata.operators.completion import RateLimited, complete_kept
from lodestrata.operators.services import ChatClient, SentenceEmbedder
from lodestrata.sources import pins, results

from test_engine import OTHER, PIN, built, fake_client  # noqa: F401


def limited(calls):
    """A client of which the first calls succeed and the rest meet the daily limit."""

    class Limited:
        n = 0

        def complete(self, prompt, max_tokens, temperature):
            self.n += 1
            if self.n > calls:
                raise RateLimited("tokens per day (TPD), try again in 2h1m3.4s")
            return fake_client().complete(prompt, max_tokens, temperature)

    return Limited()


def no_summaries():
    class Limited:
        def complete(self, prompt, max_tokens, temperature):
            if "Sum up its risk profile" in prompt:
                raise RateLimited("tokens per day (TPD), try again in 2h1m3.4s")
            return fake_client().complete(prompt, max_tokens, temperature)

    return Limited()


def test_llm_metrics(built):  # noqa: F811
    answers, scores, missing = flows.run_llm_metrics(built["chunks"], built["pins"], fake_client)
    got = {r["question_id"]: r for r in answers.collect()}
    assert set(got) == {f"{t} {q}" for t in ("ACME", "ZED") for q in ("revenue", "net_income")}
    assert got["ACME revenue"]["stated"] == {"94,827": False, "97,690": False} and "41,000" in got["ACME revenue"]["check"]["unverified_figures"]
    assert scores.count() == 12 and {r["ticker"]: r["categories"] for r in missing.collect()} == {"ACME": ["Legal Risk"], "ZED": ["Legal Risk"]}


def test_scores_stay_where_the_quota_ends(built, tmp_path):  # noqa: F811
    scores, reason = flows.score_risk(built["chunks"], built["pins"], partial(limited, 5))
    assert scores.count() == 5 and "daily quota exhausted" in reason
    scores, reason = flows.score_risk(built["chunks"], built["pins"], fake_client)
    assert scores.count() == 12 and reason is None
    path = str(tmp_path / "replies")
    scores, reason = flows.score_risk(built["chunks"], built["pins"], partial(limited, 1), replies=path)
    first = scores.count()
    assert 1 <= first < 12 and "daily quota exhausted" in reason
    again, reason = flows.score_risk(built["chunks"], built["pins"], fake_client, replies=path)
    assert again.count() == 12 and reason is None
    never, reason = flows.score_risk(built["chunks"], built["pins"], partial(limited, 0), replies=path)
    assert never.count() == 12 and reason is None


def test_a_refused_run_keeps_the_former_result(spark, built, tmp_path):  # noqa: F811
    path, acme = str(tmp_path / "kept"), pins.pins_table(spark, [PIN])
    first = flows.run_and_cache(built["chunks"], acme, fake_client, path, "Run 1", created="2026-01-01 10:00").collect()
    assert [tuple(r) for r in first] == [("ACME", True, None)]
    for client in (partial(limited, 3), no_summaries):  # refused while scoring, and at the summary
        again = flows.run_and_cache(built["chunks"], acme, client, path, "Run 2", created="2026-01-02 10:00").first()
        assert again["saved"] is False and again["message"].endswith("Try again in about 2h1m3s.")
        assert [r["source"] for r in results.load_results(spark, path).collect()] == ["Run 1"]


def test_replies_are_kept_by_step(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"prompt {i}" if i % 7 else None) for i in range(40)], "id long, prompt string")

    class Echo:
        def complete(self, prompt, max_tokens, temperature):
            return prompt.upper()

    class Tired:
        n = 0

        def complete(self, prompt, max_tokens, temperature):
            self.n += 1
            if self.n > 2:
                raise RateLimited("requests per day")
            return prompt.upper()

    path = str(tmp_path / "replies")
    first = {r["id"]: r for r in complete_kept(rows, "id", path, Tired, 10, steps=4).collect()}
    kept = {i for i, r in first.items() if r["reply"]}
    assert len(kept) == 2 and all(r["stopped"] for i, r in first.items() if i not in kept and i % 7) and all(first[i]["stopped"] is None for i in range(0, 40, 7))

    asked = str(tmp_path / "asked")

    class Recording:
        def complete(self, prompt, max_tokens, temperature):
            with open(asked, "a") as f:
                f.write(prompt + "\n")
            return prompt.upper()

    again = {r["id"]: r for r in complete_kept(rows, "id", path, Recording, 10, steps=4).collect()}
    assert all(again[i]["reply"] == (f"PROMPT {i}" if i % 7 else None) and again[i]["stopped"] is None for i in range(40))
    assert sorted(open(asked).read().split("\n")[:-1]) == sorted(f"prompt {i}" for i in range(40) if i % 7 and i not in kept)
    assert complete_kept(rows, "id", path, Tired, 10, steps=4).filter("reply IS NULL AND prompt IS NOT NULL").count() == 0


def test_chat_client():
    seen = []

    def answer(request, timeout):
        seen.append((request.full_url, json.loads(request.data), request.headers))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "hello"}}]}).encode())

    client = ChatClient("https://chat.example/v1/", "m", "key", answer)
    assert client.complete("hi", None, 0.1) == "hello" and client.complete("hi", 7, 0.5) == "hello"
    assert seen[0][0] == "https://chat.example/v1/chat/completions" and "max_tokens" not in seen[0][1] and seen[1][1]["max_tokens"] == 7
    assert seen[0][2]["Authorization"] == "Bearer key" and seen[0][1]["messages"] == [{"role": "user", "content": "hi"}]

    def refuse(code):
        def open_(request, timeout):
            headers = email.message.Message()
            headers["retry-after"] = "7"
            raise urllib.error.HTTPError(request.full_url, code, "no", headers, io.BytesIO(b"tokens per minute"))

        return ChatClient("https://chat.example", "m", "key", open_)

    with pytest.raises(RateLimited, match="tokens per minute") as error:
        refuse(429).complete("hi", None, 0.1)
    assert error.value.retry_after == "7"
    with pytest.raises(urllib.error.HTTPError):
        refuse(500).complete("hi", None, 0.1)
    with pytest.raises(ValueError):
        ChatClient("", "m", "key")


def test_sentence_embedder():
    class Fake:
        def __init__(self, name):
            self.name = name

        def encode(self, texts, normalize_embeddings):
            return [[len(t), 1.0] for t in texts]

    made = SentenceEmbedder("small", Fake)
    assert made.model.name == "small" and made.embed(["ab", "c"]).dtype == np.float32 and made.embed([]).shape[0] == 0


@pytest.fixture(scope="module")
def registry(tmp_path_factory):
    root = tmp_path_factory.mktemp("registry")
    text = "\n".join("[[filing]]\n" + "\n".join(f"{k} = {json.dumps(v)}" for k, v in p.items()) for p in (PIN, OTHER))
    (root / "filings.toml").write_text(text, encoding="utf-8")
    (root / "facts.toml").write_text('[ACME]\nnotes = ["A note."]\n[[ACME.facts]]\nid = "r"\ntopic = "scale"\nlabel = "Revenue"\nsection = "8"\nstatement = "income"\nquote = "Total revenues | 2025: 900"\nvalue = "900"\nunit = "millions"\n', encoding="utf-8")
    (root / "bad.toml").write_text('[ACME]\n[[ACME.facts]]\nid = "r"\ntopic = "scale"\nlabel = "Revenue"\nsection = "8"\nquote = "Total takings | 2025: 900"\n', encoding="utf-8")
    (root / "labels.csv").write_text("company,category,my_score,my_reason\nACME,FX Risk,7,x\nZED,Legal Risk,3,y\n", encoding="utf-8")
    return root


def test_commands(spark, built, registry, capsys):  # noqa: F811
    root, filings = registry, str(built["root"] / "edgar")
    common = ["--pins", str(root / "filings.toml"), "--filings", filings, "--store", str(root / "chunks"), "--out", str(root / "out")]
    assert commands.main(["evaluate", *common], spark) == 1
    assert commands.main(["ingest", *common], spark) == 0
    told = capsys.readouterr().out
    assert "error:" in told and "ACME: " in told and "Item 7A: " in told
    assert commands.main(["evaluate", *common], spark) == 0
    lines = commands.evaluate_command(spark, str(root / "filings.toml"), str(root / "chunks"), str(root / "labels.csv"), str(root / "out2"), fake_client)
    assert any(x.startswith("ACME") and "FX Risk" in x and x.endswith("yes") for x in lines) and any("n/a" in x for x in lines) and "within 1: 1 of 2; total gap 1, largest 1" in lines
    assert commands.main(["factsheets", *common, "--facts", str(root / "bad.toml"), "--labels", str(root / "template")], spark) == 1
    assert "quote found on 0 distinct lines" in capsys.readouterr().out and not (root / "template").exists()
    assert commands.main(["factsheets", *common, "--facts", str(root / "facts.toml"), "--out", str(root / "sheets"), "--labels", str(root / "template")], spark) == 0
    (sheet,) = (root / "sheets" / "ticker=ACME").glob("part-*")
    assert "Total revenues | 2025: 900" in sheet.read_text(encoding="utf-8") and list((root / "template").glob("part-*"))
    assert set(CATEGORY_QUERIES)
