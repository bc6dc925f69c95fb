"""DataFrame -> DataFrame operators; nothing here runs an action unless its docstring says so."""
