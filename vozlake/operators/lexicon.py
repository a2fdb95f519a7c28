"""Starter tables: a small hand-weighted sentiment model and language profiles.

They let every job run before a fitted table exists. Production use replaces
them with the output of ``fitting.fit_logreg`` / ``fitting.fit_language_profiles``.
"""

from __future__ import annotations

# feature, idf, weight Negativo, weight Neutro, weight Positivo
STARTER_MODEL = (
    ("trash", 4.5, 2.6, -0.9, -1.7), ("scum", 4.6, 2.5, -0.8, -1.7),
    ("idiot", 4.5, 2.6, -0.9, -1.7), ("clown", 4.6, 2.3, -0.8, -1.5),
    ("worthless", 4.5, 2.5, -0.9, -1.6), ("moron", 4.6, 2.5, -0.9, -1.6),
    ("pathetic", 4.5, 2.4, -0.8, -1.6), ("loser", 4.6, 2.4, -0.8, -1.6),
    ("disgusting", 4.5, 2.6, -0.9, -1.7), ("stupid", 4.6, 2.4, -0.8, -1.6),
    ("terrible", 4.0, 2.4, -0.8, -1.6), ("horrible", 4.0, 2.4, -0.8, -1.6),
    ("malo", 3.8, 2.1, -0.6, -1.5), ("mala", 3.8, 2.1, -0.6, -1.5),
    ("pésimo", 4.2, 2.6, -0.9, -1.7), ("pésima", 4.2, 2.6, -0.9, -1.7),
    ("roto", 4.1, 2.0, -0.5, -1.5), ("tarde", 3.9, 1.6, -0.2, -1.4),
    ("reclamo", 4.0, 1.8, -0.3, -1.5), ("nunca", 3.7, 1.5, -0.3, -1.2),
    ("no funciona", 4.4, 2.2, -0.6, -1.6), ("no recomiendo", 4.4, 2.4, -0.7, -1.7),
    ("excelente", 4.0, -1.8, -0.8, 2.6), ("bueno", 3.6, -1.3, -0.5, 1.8),
    ("buena", 3.6, -1.3, -0.5, 1.8), ("gracias", 3.8, -1.2, -0.5, 1.7),
    ("perfecto", 4.0, -1.7, -0.7, 2.4), ("recomiendo", 3.9, -1.2, -0.6, 1.8),
    ("encanta", 4.1, -1.6, -0.7, 2.3), ("muy bueno", 4.2, -1.6, -0.6, 2.2),
    ("great", 3.9, -1.6, -0.7, 2.3), ("good", 3.5, -1.2, -0.5, 1.7),
    ("factura", 3.9, -0.4, 1.4, -1.0), ("pedido", 3.7, -0.2, 1.0, -0.8),
    ("entrega", 3.8, -0.1, 0.8, -0.7), ("horario", 4.0, -0.5, 1.5, -1.0),
    ("licensed", 4.3, -0.6, 1.8, -1.2), ("under the", 3.6, -0.5, 1.5, -1.0),
    ("the and", 4.8, -0.8, 2.6, -1.8), ("was and", 3.4, -0.3, 0.9, -0.6),
    ("the", 1.2, -0.3, 0.1, 0.2), ("of", 1.2, -0.2, 0.1, 0.1),
    ("and", 1.3, -0.2, 0.2, 0.0), ("to", 1.3, 0.1, -0.2, 0.1),
    ("was", 1.4, 0.2, 0.1, -0.3), ("with", 1.4, -0.1, 0.2, -0.1),
    ("this", 1.5, 0.1, -0.3, 0.2), ("from", 1.5, -0.2, 0.5, -0.3),
    ("not", 2.4, 0.6, -0.1, -0.5), ("nicht", 2.4, 0.5, -0.1, -0.4),
    ("der", 1.8, -0.1, 0.3, -0.2), ("die", 1.8, 0.1, 0.2, -0.3),
    ("und", 1.8, -0.2, -0.1, 0.3), ("mit", 1.9, -0.1, 0.4, -0.3),
    ("de", 1.7, -0.1, 0.2, -0.1), ("la", 1.7, 0.2, -0.3, 0.1),
    ("les", 1.9, -0.2, 0.4, -0.2), ("pas", 2.2, 0.5, -0.1, -0.4),
    ("que", 1.8, 0.3, -0.2, -0.1), ("no", 2.1, 0.6, -0.1, -0.5),
    ("de la", 2.6, -0.1, 0.5, -0.4), ("of the", 2.5, -0.2, 0.6, -0.4),
)
STARTER_INTERCEPTS = (-0.90, -0.25, 1.30)

STARTER_PROFILES = {
    "de": "der die und den von das zu mit sich für des nicht auf ist im dem ein eine als",
    "en": "the of and to is that it was for on with as by be this are at from not",
    "es": "el los las del se por una para su es al lo con no que en un de la",
    "fr": "le les et des du une pour est qui dans par sur pas au avec que un de la",
    "it": "il di che è per della sono gli non con una nel più anche questo come in la",
    "pt": "o os do da em um uma para com não as dos mais por foi ao muito que de",
}
# every profile word counts the same until profiles are fitted
STARTER_PROFILE_WEIGHT = 1.0
