"""A judge behind an HTTP chat-completions interface. Answers are untrusted text: definitions.answer_errors checks them."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from .definitions import VERDICTS, JudgeError

TEXT = {"type": "string"}
PROPERTIES = {
    "candidate_id": TEXT,
    "verdict": {"type": "string", "enum": VERDICTS},
    "rationale": TEXT,
    "left_sql_quote": TEXT,
    "right_sql_quote": TEXT,
    "confidence": {"type": "number"},
}
FORMAT = {"type": "json_schema", "json_schema": {"name": "verdict", "strict": True, "schema": {"type": "object", "properties": PROPERTIES, "required": list(PROPERTIES), "additionalProperties": False}}}


def api_key() -> str:
    return os.environ.get("ESTATELENS_API_KEY", "")


@dataclass
class ChatProvider:
    """Asks a model for a JSON object of fixed fields, without randomness, and counts the tokens that it reports."""

    model: str
    url: str
    key: str = field(default_factory=api_key, repr=False)
    timeout: float = 120
    name: str = "chat"
    usage: tuple[int, int] = (0, 0)

    def __post_init__(self):
        if not self.key:
            raise JudgeError("the judge needs an API key")

    def body(self, prompt: str) -> dict:
        return {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}], "response_format": FORMAT}

    def complete(self, prompt: str) -> str:
        reply = self._post(self.body(prompt))
        counts = reply.get("usage") or {}
        self.usage = int(counts.get("prompt_tokens", 0)), int(counts.get("completion_tokens", 0))
        match reply:
            case {"choices": [{"message": {"content": str(content)}}, *_]}:
                return content
        raise JudgeError("the judge's reply holds no answer")

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                reply = json.load(answer)
        except (urllib.error.URLError, TimeoutError) as e:
            raise JudgeError(f"the judge can't be reached: {e}") from e
        except ValueError as e:
            raise JudgeError("the judge's reply is not JSON") from e
        if not isinstance(reply, dict):
            raise JudgeError("the judge's reply is not an object")
        return reply
