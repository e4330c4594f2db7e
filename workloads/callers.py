"""Models of the workloads: plain functions of the prompt, some of whose calls fail."""

from __future__ import annotations

import json


def extractor():
    """Two facts about a transcript; fails on every seventh length, has nothing to say on every fifth."""

    def reply(prompts):
        if any(len(p) % 7 == 0 for p in prompts):
            raise RuntimeError("provider down")
        return ["" if len(p) % 5 == 0 else json.dumps({"facts": [f"{len(p)} characters", f"{p.count(chr(10)) + 1} lines"]}) for p in prompts]

    return reply


def reflector():
    """Asks again if the first line of the prompt has an odd number of characters."""
    again = {"status": "INCOMPLETE", "question": "what did I say before"}
    return lambda prompt: json.dumps(again if len(prompt.split("\n")[0]) % 2 else {"status": "COMPLETE"})


def judger():
    """Compares the answer with the reference; fails or evades on some answers."""

    def reply(prompt):
        said = dict(line.split(": ", 1) for line in prompt.split("\n") if ": " in line)
        number = int(said["Answer"].split()[-1])
        if number % 11 == 0:
            raise RuntimeError("provider down")
        if number % 13 == 0:
            return "I cannot tell."
        return "Verdict: " + ("CORRECT" if said["Answer"] == said["Reference answer"] else "WRONG")

    return reply
