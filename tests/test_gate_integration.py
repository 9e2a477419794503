"""Whole-gate cases through the raw JSON path: header list -> normalize ->
gate (verdict, skip, sub-action, score bounds)."""

import json

import pytest

from mailsift.operators import gate as G
from mailsift.sources import messages as SM

from test_sources import b64


def raw(subject, from_, body, extra_headers=(), html=None):
    headers = [{"name": "From", "value": from_}, {"name": "To", "value": "user@example.com"},
               {"name": "Subject", "value": subject}] + [{"name": k, "value": v} for k, v in extra_headers]
    parts = [{"mimeType": "text/plain", "body": {"size": len(body), "data": b64(body)}}]
    if html:
        parts.append({"mimeType": "text/html", "body": {"size": len(html), "data": b64(html)}})
    return {"id": "m", "payload": {"mimeType": "multipart/alternative", "headers": headers, "body": {"size": 0},
                                   "parts": parts}}


CASES = {
    "obvious_spam": raw("50% Off Everything!", "Deals Newsletter <noreply@marketing.bigstore.com>",
                        "Amazing sale! 50% off everything. Click here to unsubscribe.",
                        [("List-Unsubscribe", "<mailto:unsub@bigstore.com>"), ("Precedence", "bulk")]),
    "personal": raw("Re: Contract review", "Sarah Chen <sarah@acme.com>",
                    "Hi Sam, can you confirm Friday at 2pm PT works for the contract review?"),
    "ambiguous": raw("Your weekly project update", "Project Bot <updates@internal-tool.com>",
                     "Hi team, here is this week's project status. Can you review the milestones? "
                     "Manage your notification settings here."),
    "noreply_unsubscribe": raw(
        "Your Monthly Statement", "No Reply <no-reply@bank-marketing.com>",
        "View your statement online. You are receiving this email because you are a customer. "
        "Unsubscribe from marketing emails.", [("List-Unsubscribe", "<https://bank-marketing.com/unsub>")],
        html='<html><body><p>View your statement</p><img src="https://track.com/p.gif" width="1" height="1">'
             '</body></html>'),
    "newsletter": raw("Tech Weekly Newsletter - Issue #142", "Tech Weekly Newsletter <newsletter@techweekly.com>",
                      "This week's newsletter: Top 10 programming languages. To unsubscribe, click here.",
                      [("List-Unsubscribe", "<mailto:unsub@techweekly.com>"), ("Precedence", "bulk")]),
    "plain": raw("hello", "alice@example.com", "Just a normal email with no signals."),
}


@pytest.fixture(scope="module")
def gated(spark):
    names = list(CASES)
    rows = [(i, json.dumps(CASES[n])) for i, n in enumerate(names)]
    good, bad = SM.validate_raw(SM.parse_raw(spark.createDataFrame(rows, "position long, value string")))
    assert bad.count() == 0
    out = G.run_gate(SM.normalize(good)).collect()
    return {names[r.position]: r for r in out}


def test_obvious_spam_skips_model(gated):
    r = gated["obvious_spam"]
    assert r.verdict == "spam" and r.skip_llm and r.score >= 0.70


def test_personal_email_passes_through(gated):
    r = gated["personal"]
    assert r.verdict == "not_spam" and not r.skip_llm and r.score <= 0.20


def test_ambiguous_goes_to_model_with_signals(gated):
    r = gated["ambiguous"]
    assert not r.skip_llm and r.score > 0 and r.verdict == "ambiguous"


def test_noreply_with_unsubscribe_is_spam(gated):
    r = gated["noreply_unsubscribe"]
    assert r.verdict == "spam" and r.skip_llm and "tracking_pixels" in r.fired


def test_newsletter_sub_action(gated):
    r = gated["newsletter"]
    assert r.verdict == "spam" and r.sub_action_key == "SPAM_NEWSLETTER"


def test_all_signals_present_and_score_bounded(gated):
    for r in gated.values():
        assert len(r.signals) == 16 and 0.0 <= r.score <= 1.0
        assert set(r.fired) == {s.name for s in r.signals if s.fired}
