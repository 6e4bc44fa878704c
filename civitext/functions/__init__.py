from civitext.functions import labels, scores, text, tokens

__all__ = ["labels", "scores", "text", "tokens"]
