from tastebud.functions.text import normalize_text, join_text, word_tokens, with_bigrams, alpha_tokens
from tastebud.functions.numeric import r6, uniform, safe_div, age_band
from tastebud.functions.index import dense_index

__all__ = ["normalize_text", "join_text", "word_tokens", "with_bigrams", "alpha_tokens",
           "r6", "uniform", "safe_div", "age_band", "dense_index"]
