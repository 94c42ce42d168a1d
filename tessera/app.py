"""Demo page: ask a question of an index in a browser. Standard library alone."""

from __future__ import annotations

import html
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

from tessera.functions.misc import MODES
from tessera.operators.models import ANSWER_PROMPT

QUESTIONS = [
    "Which components make retrieval slow, and why?",
    "How could document retrieval use hybrid search?",
    "What is the open problem with the message broker?",
    "Give an overview of the main contribution opportunities.",
]


def respond(index: dict, client, question: str, mode: str = "auto", answer: bool = True, context: bool = True) -> dict[str, str]:
    """What the page shows of a question: the mode that was taken, and the answer and context if asked for."""
    from tessera.cli import ask, prompt_context

    taken, rows = ask(index, question, mode)
    text = prompt_context(rows)
    out = {"mode": taken}
    if answer:
        out["answer"] = client().complete(ANSWER_PROMPT.replace("{question}", question).replace("{context}", text))
    if context:
        out["context"] = text
    return out


def page(asked: dict[str, str] | None = None, found: dict[str, str] | None = None) -> str:
    """The form, and below it what was found."""
    asked, esc = asked or {"question": QUESTIONS[0], "mode": "auto", "answer": "on", "context": "on"}, html.escape
    pick = "".join(f"<option{' selected' if m == asked.get('mode') else ''}>{m}</option>" for m in MODES)
    box = lambda name, label: f"<label><input type=checkbox name={name}{' checked' if asked.get(name) else ''}> {label}</label> "
    demo = "".join(f"<option value='{esc(q, True)}'>" for q in QUESTIONS)
    body = "".join(f"<h2>{esc(k.capitalize())}</h2><pre>{esc(v)}</pre>" for k, v in (found or {}).items())
    return (
        "<!doctype html><meta charset=utf-8><title>tessera</title><h1>tessera</h1><form method=post>"
        f"<input name=question list=demo size=90 value='{esc(asked.get('question', ''), True)}'><datalist id=demo>{demo}</datalist>"
        f"<p><select name=mode>{pick}</select> {box('answer', 'Answer')}{box('context', 'Context')}<button>Run</button></form>{body}"
    )


def serve(index: dict, client, port: int = 8501) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, text: str) -> None:
            raw = text.encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._send(page())

        def do_POST(self) -> None:
            asked = {k: v[0] for k, v in parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()).items()}
            try:
                found = respond(index, client, asked.get("question", ""), asked.get("mode", "auto"), "answer" in asked, "context" in asked)
            except Exception as e:  # shown on the page; the server goes on
                found = {"error": str(e)}
            self._send(page(asked, found))

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()
