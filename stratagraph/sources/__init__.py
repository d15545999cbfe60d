"""Where relations come from: standard tables, file trees, change histories, snapshots."""
