"""The store's verbs: backup, list, restore, purge."""
