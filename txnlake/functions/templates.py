"""Message templates: one regular expression per field.

A template is ``{"bank", "name", "fields": {field: (pattern, group_number)}, "required", "needs"}``; ``needs`` is a
pattern that every matching message must contain, a cheap test before the fields. Templates written elsewhere with
named groups come in through ``from_named_patterns``.
"""

from __future__ import annotations

import re

ARABIC = r"[\u0600-\u06FF]"


def from_named_patterns(bank: str, name: str, patterns: dict[str, str], required: list[str] | None = None) -> dict:
    """A template from patterns with ``(?P<field>...)`` groups.

    Java group names allow no underscore, so groups are addressed by number. The group named
    after the field wins, else the first named group that matched.
    """
    fields = {}
    for field, pattern in patterns.items():
        try:
            groups = re.compile(pattern).groupindex
        except re.error:
            continue
        if not groups:
            continue
        numbers = [groups[field]] if field in groups else []
        numbers += [n for g, n in groups.items() if g != field]
        fields[field] = (re.sub(r"\(\?P<\w+>", "(", pattern), numbers if len(numbers) > 1 else numbers[0])
    return {"bank": bank, "name": name, "required": required or ["amount"], "fields": fields}


# --- fixed values: the stock templates, whole patterns in their order ----------------------

STOCK_TEMPLATES = [
    {
        "bank": "HSBC", "name": "HSBC Standard Transaction", "required": ["amount", "currency"], "needs": None,
        "fields": {
            "amount": (r"(?:charged|debited|paid|amount|of)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(EGP|USD|EUR|SAR|AED)", 1),
            "date": (r"(?:on|date)\s+(\d{2}[/-]\d{2}[/-]\d{2,4}|\d{4}[/-]\d{2}[/-]\d{2})", 1),
            "payee": (r"(?:at|from|to)\s+([A-Za-z0-9\s]+?)(?:\s+on|\.|$)", 1),
            "transaction_type": (r"(POS|ATM|Online|Purchase|Withdrawal|Transfer|Payment)", 1),
            "card_suffix": (r"(?:ending|card)\s+(\d{4})", 1),
        },
    },
    {
        "bank": "HSBC", "name": "HSBC Arabic Transaction", "required": ["amount"], "needs": ARABIC,
        "fields": {
            "amount": (r"(?:خصم|دفع|مبلغ)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(جنيه|دولار|يورو|ريال)", 1),
            "date": (r"(?:في|بتاريخ)\s+(\d{2}[/-]\d{2}[/-]\d{2,4})", 1),
            "payee": (r"(?:في|من|الى)\s+([\u0600-\u06FFA-Za-z0-9\s]+?)(?:\s|$)", 1),
            "transaction_type": (r"(صراف|شراء|سحب|تحويل|دفع)", 1),
            "card_suffix": (r"(?:رقم|بطاقة)\s+(\d{4})", 1),
        },
    },
    {
        "bank": "CIB", "name": "CIB Standard Transaction", "required": ["amount", "currency"], "needs": None,
        "fields": {
            "amount": (r"(?:charged|debited|of|amount)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(EGP|USD|EUR)", 1),
            "date": (r"(?:on|date)\s+(\d{2}[/-]\d{2}[/-]\d{2,4})", 1),
            "payee": (r"(?:at|from)\s+([A-Za-z0-9\s]+?)(?:\s+on|\.|,)", 1),
            "transaction_type": (r"(POS|ATM|Online|Purchase)", 1),
            "card_suffix": (r"(?:card ending|ending)\s+(\d{4})", 1),
        },
    },
    {
        "bank": "CIB", "name": "CIB Arabic Transaction", "required": ["amount"], "needs": ARABIC,
        "fields": {
            "amount": (r"(?:خصم|دفع|مبلغ)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(جنيه|دولار)", 1),
            "date": (r"(?:في|بتاريخ)\s+(\d{2}[/-]\d{2}[/-]\d{2,4})", 1),
            "payee": (r"(?:في|من)\s+([\u0600-\u06FFA-Za-z0-9\s]+?)(?:\s|$)", 1),
            "transaction_type": (r"(شراء|سحب|نقطة بيع)", 1),
            "card_suffix": (r"(?:بطاقة رقم|رقم)\s+(\d{4})", 1),
        },
    },
    {
        "bank": "NBE", "name": "NBE Standard Transaction", "required": ["amount", "currency"], "needs": None,
        "fields": {
            "amount": (r"(?:charged|debited|withdrawal|of)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(EGP|USD)", 1),
            "date": (r"(?:on|date)\s+(\d{2}[/-]\d{2}[/-]\d{4})", 1),
            "payee": (r"(?:at|merchant)\s+([A-Za-z0-9\s]+?)(?:\s|\.|,|$)", 1),
            "transaction_type": (r"(POS|ATM|Purchase|Withdrawal)", 1),
            "card_suffix": (r"(?:card)\s+(\d{4})", 1),
        },
    },
    {
        "bank": "NBE", "name": "NBE Arabic Transaction", "required": ["amount"], "needs": ARABIC,
        "fields": {
            "amount": (r"(?:خصم|سحب|مبلغ)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(جنيه|دولار)", 1),
            "date": (r"(?:في|بتاريخ)\s+(\d{2}[/-]\d{2}[/-]\d{4})", 1),
            "payee": (r"(?:من|في)\s+([\u0600-\u06FFA-Za-z0-9\s]+?)(?:\s|$)", 1),
            "transaction_type": (r"(صراف آلي|نقطة بيع|سحب)", 1),
            "card_suffix": (r"(?:بطاقة)\s+(\d{4})", 1),
        },
    },
    {
        "bank": "QNB", "name": "QNB Standard Transaction", "required": ["amount", "currency"], "needs": None,
        "fields": {
            "amount": (r"(?:charged|debited|amount|of)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(EGP|USD|SAR)", 1),
            "date": (r"(?:on|date)\s+(\d{2}[/-]\d{2}[/-]\d{2,4})", 1),
            "payee": (r"(?:at|from)\s+([A-Za-z0-9\s]+?)(?:\s+on|\.|$)", 1),
            "transaction_type": (r"(POS|ATM|Online)", 1),
            "card_suffix": (r"(?:ending)\s+(\d{4})", 1),
        },
    },
    {
        "bank": "QNB", "name": "QNB Arabic Transaction", "required": ["amount"], "needs": ARABIC,
        "fields": {
            "amount": (r"(?:خصم|دفع|مبلغ)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(جنيه|ريال)", 1),
            "date": (r"(?:في|بتاريخ)\s+(\d{2}[/-]\d{2}[/-]\d{4})", 1),
            "payee": (r"(?:في|من)\s+([\u0600-\u06FFA-Za-z0-9\s]+?)(?:\s|$)", 1),
            "transaction_type": (r"(نقطة بيع|صراف|إلكتروني)", 1),
            "card_suffix": (r"(?:رقم)\s+(\d{4})", 1),
        },
    },
    {
        "bank": "Generic_Bank", "name": "Generic Transaction", "required": ["amount"], "needs": None,
        "fields": {
            "amount": (r"(?:charged|debited|amount|transaction|of|paid)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(EGP|USD|EUR|SAR|AED|GBP)", 1),
            "date": (r"(?:on|date)\s+(\d{2}[/-]\d{2}[/-]\d{2,4}|\d{4}[/-]\d{2}[/-]\d{2})", 1),
            "payee": (r"(?:at|from|to|merchant)\s+([A-Za-z0-9\s]{3,30}?)(?:\s+on|for|\.|,|$)", 1),
            "transaction_type": (r"(POS|ATM|Online|Purchase|Withdrawal|Transfer|Payment)", 1),
            "card_suffix": (r"(?:ending|card|card ending|\*\*)\s*(\d{4})", 1),
        },
    },
    {
        "bank": "Generic_Bank", "name": "Generic Arabic Transaction", "required": ["amount"], "needs": ARABIC,
        "fields": {
            "amount": (r"(?:خصم|دفع|مبلغ|تحويل)\s+(\d+(?:[,.]\d{2})?)", 1),
            "currency": (r"(?:\d+(?:[,.]\d{2})?)\s+(جنيه|دولار|يورو|ريال)", 1),
            "date": (r"(?:في|بتاريخ)\s+(\d{2}[/-]\d{2}[/-]\d{2,4})", 1),
            "payee": (r"(?:في|من|الى|التاجر)\s+([\u0600-\u06FFA-Za-z0-9\s]{3,30}?)(?:\s|$)", 1),
            "transaction_type": (r"(صراف|شراء|سحب|تحويل|دفع|نقطة بيع)", 1),
            "card_suffix": (r"(?:رقم|بطاقة|ينتهي)\s+(\d{4})", 1),
        },
    },
]
