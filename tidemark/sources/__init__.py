"""Where rows come from: session directories, stored tables and the test tables seen as sessions."""
