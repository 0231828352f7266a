"""Column functions: text, words, splits, prompts, markers and token counts."""
