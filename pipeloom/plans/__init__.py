"""Query text to bound plan: lexer, parser, binder, plan text."""
