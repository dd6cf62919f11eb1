from .similarity import (char_jaccard, characters, edit_similarity, jaccard,
                         masked_similarity, template_similarity)
from .text import (PUNCTUATION, WILDCARD, canonical_template, correct_message,
                   fold_wildcards, format_signature, mask_message,
                   match_tokens, message_tokens, remove_punctuation,
                   repair_response, rule_label, scoring_tokens, slot_labels,
                   star_digits, templates_equal_folded, tokens, words)

__all__ = [
    "PUNCTUATION", "WILDCARD", "canonical_template", "char_jaccard", "characters",
    "correct_message", "edit_similarity", "fold_wildcards", "format_signature",
    "jaccard", "mask_message", "masked_similarity", "match_tokens",
    "message_tokens", "remove_punctuation", "repair_response", "rule_label",
    "scoring_tokens", "slot_labels", "star_digits", "template_similarity",
    "templates_equal_folded", "tokens", "words",
]
