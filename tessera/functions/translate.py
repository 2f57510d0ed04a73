"""The online part of the translation chain: injected translators, tried in order, batch by batch on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def translate_pending(pending: DataFrame, chain: list[tuple[str, Callable[[str], str]]]) -> DataFrame:
    """(id, text, translated, provider): each text by the first translator whose answer differs from it; the text itself if none does.

    Equal texts of a batch are asked for once. A translator that fails is passed over.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            answers = {}
            for text in pdf["text"].unique():
                answers[text] = (text, "original")
                for name, ask in chain:
                    try:
                        said = ask(text)
                    except Exception:
                        continue
                    if said and said.strip().lower() != text.strip().lower():
                        answers[text] = (said, name)
                        break
            yield pd.DataFrame({"id": pdf["id"], "text": pdf["text"], "translated": [answers[t][0] for t in pdf["text"]], "provider": [answers[t][1] for t in pdf["text"]]})

    return pending.select("id", "text").mapInPandas(run, "id string, text string, translated string, provider string")
