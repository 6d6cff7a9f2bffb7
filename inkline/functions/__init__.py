"""Part of inkline; see the README."""
