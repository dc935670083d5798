"""Advice texts as rows (gate, bucket, language or '*', position, text)."""

from .advice_text import ADVICE


def advice_rows():
    rows = []
    for gate, texts in ADVICE.items():
        for key, text in texts.items():
            bucket, _, language = key.partition(":")
            for i, line in enumerate(text.strip().splitlines()):
                rows.append((gate, bucket, language or "*", i, line))
                if language == "javascript":
                    rows.append((gate, bucket, "typescript", i, line))
    return rows
