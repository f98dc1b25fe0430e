"""Hand-made token tables: "text/lemma/POS" with * for a stop word and ‖ between sentences."""

from phrasemill.operators.document import Token


def tokens(table: str) -> list[Token]:
    out, at = [], 0
    for sentence, part in enumerate(table.split("‖")):
        for word in part.split():
            stop = word.endswith("*")
            text, lemma, pos = word.rstrip("*").split("/")
            out.append(Token(text, lemma, pos, at, at + len(text), sentence, stop))
            at += len(text) + 1
    return out


TR1 = tokens("Machine/machine/NOUN learning/learning/NOUN is/be/VERB a/a/DET subset/subset/NOUN of/of/ADP artificial/artificial/ADJ intelligence/intelligence/NOUN")
TR3 = tokens(
    "Machine/machine/NOUN learning/learning/NOUN uses/use/VERB algorithms/algorithm/NOUN ‖ Deep/deep/ADJ learning/learning/NOUN uses/use/VERB neural/neural/ADJ networks/network/NOUN ‖ "
    "Machine/machine/NOUN learning/learning/NOUN models/model/NOUN improve/improve/VERB with/with/ADP* data/data/NOUN"
)
RICH = tokens(
    "Machine/machine/NOUN learning/learning/NOUN algorithms/algorithm/NOUN process/process/VERB large/large/ADJ datasets/dataset/NOUN ‖ "
    "Deep/deep/ADJ learning/learning/NOUN models/model/NOUN use/use/VERB neural/neural/ADJ networks/network/NOUN ‖ "
    "Machine/machine/NOUN learning/learning/NOUN techniques/technique/NOUN improve/improve/VERB data/data/NOUN analysis/analysis/NOUN ‖ "
    "Neural/neural/ADJ networks/network/NOUN enable/enable/VERB deep/deep/ADJ learning/learning/NOUN applications/application/NOUN"
)
