"""Where rows come from: text tables, file trees, archives."""
