"""Operators for preparing training text: duplicates, rules, archives, tokens, languages, chats."""
