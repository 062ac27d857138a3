"""Tessera: declarative harvesting of structured facts from wiki text, as Spark plans."""
