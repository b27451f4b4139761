"""Digests (SHA-256 of the loose form) of the common full licenses, each with and without its title and with and without what follows its terms."""

DIGESTS: dict[str, str] = {
    "135f996b0799264a94667b307181b4e708ac75af3dd183e62a37bd0555cbf0cc": "0BSD",
    "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c": "0BSD",
    "39940ee96cfc4ad10916b4d3d0cd7421ef7624fcf0751d448987405ca979812e": "0BSD",
    "53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe": "0BSD",
    "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153": "0BSD",
    "2b4a3f34572f63637f58db72bdacad38516a1e1e6788b08931d0a0d5c0be33dd": "Apache-2.0",
    "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959": "Apache-2.0",
    "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859": "Apache-2.0",
    "7c15fde9438f81f4fb322ce23d53a5a5cb95d7fe7553460bb6df26d764bc88c2": "Apache-2.0",
    "a20a662d0b3511d4870fcdf3b089a8572d5d19a588da4d56abdc49fe6927d1ec": "Apache-2.0",
    "d691dbaa962e00c7e2935158f280efd998231d738446d1fe896f80df4e354b1f": "Apache-2.0",
    "d7dd8e5c661e35d656a43688fc21624b0ba52216e4c419c747129bf83780d165": "Apache-2.0",
    "dcd4e2beaa29b333fb4122f9d774f16cb1d1a0418406bc12f019b8824c64879e": "Apache-2.0",
    "e51957a003c624f62a57501de457fc8fe81e5b84b51b29742b8093649cec5476": "Apache-2.0",
    "f761755a124d5b120462472e2bc82cd8441992f62440982a246977b1e7f8b8dc": "Apache-2.0",
    "fb388936c12fba660a278043424b3f9a17c6b2e536674e390813ac3d06e7e73a": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "2588c061b2bcc804aa056817c8c0475625d532132149c086f8e194314cd73e27": "Artistic-1.0-Perl",
    "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c": "Artistic-1.0-Perl",
    "6eaa4933a62e17cad6344dd7a9d119baf4fe725ccb85223325ebac7c50ab05d0": "Artistic-1.0-Perl",
    "051603ddd636ab11c9b3a8b8c63846554a0d5b858cfff0b805ed1209ead76d08": "BSD-2-Clause",
    "07009138c2c60079b5c0af517b8bd8b4b42ffc843cc131a20d92d08a8f23f9fd": "BSD-2-Clause",
    "08d0968df2e75188ce1a3dcc21910a243b3b023c7317e319878b91003ecf2ab5": "BSD-2-Clause",
    "10677e704f35e9d68ab40192dc9035db9a743691d71ad0f39d1ae44a81d27e98": "BSD-2-Clause",
    "142d228cbf13919f7252309714bfbfc893faffda1e9ce26e9498084a3d127107": "BSD-2-Clause",
    "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2": "BSD-2-Clause",
    "2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7": "BSD-2-Clause",
    "2d43d7fea89b3633b95184ddd4e7d55c0d384cc18515de6da01adef25b3a8439": "BSD-2-Clause",
    "2e9901df2d3cdd9b2ad2d0541a98d0ffe16ec6a54494b7837b493c08b3bde071": "BSD-2-Clause",
    "312ea33736a8c485e221afd61fb0daddefb5517d78cb2d80a94cb23bf274bf84": "BSD-2-Clause",
    "3938f828c79910468f483f925e6a33217162693f71035d6044cbd04dc6fd1bd5": "BSD-2-Clause",
    "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2": "BSD-2-Clause",
    "49fd205a8fbfe8ab8147401bc8cebae1ca8da76e864b795571c4072758c15b88": "BSD-2-Clause",
    "4a5b45ed3ca9ae854c5505a774b3659d3852be9a3412b822802b3cdbe5dc7b0a": "BSD-2-Clause",
    "57c45e73f6c2defc3cede3db54ace2a8f622164399a002ca5af96ce6bf3d965b": "BSD-2-Clause",
    "57c5e4cd5b5bdc3ba26f1a7db1c243ad2d7dcc2cd4111fed827cc05cf3fe3d0f": "BSD-2-Clause",
    "5d123f3d2076a6b22f7b17a92623627ef50d1584e8cf13b7d4040f1c6e8a0424": "BSD-2-Clause",
    "6dd7e504bbd11bc6603ccfd4547a29e67d51cda1d3590ed656ed60626f9dc38f": "BSD-2-Clause",
    "7061202489ba206b35e1e020fd1633db8013b98790929b974f0e3296ddb2e148": "BSD-2-Clause",
    "712dce7d673ff7e1550976bfd879c441ad93a2d9906c3c4ae27441d29fa3350b": "BSD-2-Clause",
    "80fbd6d700d747d5fe62a7a6df0f025777bc83660bdfd92f008f9479f9aea033": "BSD-2-Clause",
    "823bf6691b4a2eaf77ccb155d19682942e753771961115bfb02c29f621e24483": "BSD-2-Clause",
    "878feab2dcd89f9a49d6ae7c6dfb26b2a3fbf515a360dc210bc0e96a50a6758d": "BSD-2-Clause",
    "8b28f63734bf310903015ecd26ae5c979f31743ca170703b95426d7203774453": "BSD-2-Clause",
    "8dd5ff60c442d75ea64b4315dba5f4f82a2c8d7690f5ba707ec272b02cc53227": "BSD-2-Clause",
    "906e780fc682c509a8fd814ac40be591cd813ee1786cbcda395ca36480fcf989": "BSD-2-Clause",
    "94ff499e5c404adcf871a51772583fec3a7c6e6b78637c5a68519c3167c1b615": "BSD-2-Clause",
    "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74": "BSD-2-Clause",
    "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30": "BSD-2-Clause",
    "adc66a41c32009ea741a27ca9ddd9f8d85e96a6bd19c03260b0b71cceadf468e": "BSD-2-Clause",
    "add68477e31f4c39352b96a5ed22128c47aa7c46de62e8bac51e8b390c6b215c": "BSD-2-Clause",
    "b0b40a4d00b28fd8e72012bcc6d902d43016e0ea2c731164405e009b7f63d31d": "BSD-2-Clause",
    "b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893": "BSD-2-Clause",
    "b7d49d651647319f38c254df78d020e1c773cbac121d97b17eb70bf3149e7233": "BSD-2-Clause",
    "b9c37ec1c336234c1674938a34647c046845a7ca88e770ecee9dfab0c93b192a": "BSD-2-Clause",
    "bc1e385eb5d19c6613b84fb0a516cbaef80caefb192cf62a0c520c07f0fcab07": "BSD-2-Clause",
    "c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24": "BSD-2-Clause",
    "dfb735646da984cb814b2aab18aef097d6e575950073bd82353f618e44014642": "BSD-2-Clause",
    "e74f02edf06350e22d771b60d0580c53e28783fd12eda06abd03dab1348bc9d9": "BSD-2-Clause",
    "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9": "BSD-2-Clause",
    "e965bfe15cdcf092706da02c38cbf69ef02a729b58c76bb3557eec7c8c198a59": "BSD-2-Clause",
    "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b": "BSD-2-Clause",
    "02cbb88221e507a296bab4438d8c41fc55a45c1e486982b72971ef667bab440e": "BSD-3-Clause",
    "0c31f26da79530098d99f109c5e5c087b533d3212f08f3433169de29a180d282": "BSD-3-Clause",
    "1157d7738c8e4b9714da26c13a27d402141a7cfc68c80f72c30fe25698134732": "BSD-3-Clause",
    "19a4781693c27171941c3997100df63b3707e99f2135091c98fb3aba3429a921": "BSD-3-Clause",
    "214aa9c28152d6d77e6bebfb4a7511e677f65fdaf94b0fe9c0bb580e0eaf8997": "BSD-3-Clause",
    "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903": "BSD-3-Clause",
    "429b1bfa4e008beb942bfe838bbfd94e154ef4ea6bb23a8643ebd3cfd68e2fcc": "BSD-3-Clause",
    "485f1652433b74fd0a8365a4a059bdd82447b5d2a002546ff824eb1a3ef728ef": "BSD-3-Clause",
    "4e9a9bcf6572f601ae51e790787a48b5285c565547a73c9a5bd8ce87155c9dcc": "BSD-3-Clause",
    "4fec7901c0764f1c632da504aa28d5de5e7e5f0783c88d1e3fd21de4f97e315d": "BSD-3-Clause",
    "52708ae7496bad323efc341f2b977f4deecc250729644235974381dbffa10b45": "BSD-3-Clause",
    "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa": "BSD-3-Clause",
    "5a4203a0cab2e84e922f946c6ac4338d5cae9ef66167ea5e8a5e27c16e8608cb": "BSD-3-Clause",
    "5a6e7ec0b1ac1e224277a8a6d5cd7691ea38298b0308b87a7a2e539d020ed1e0": "BSD-3-Clause",
    "6c827aa2d88da121c3484287eb82e5a7209d6939d9fc71250a7a439b55469169": "BSD-3-Clause",
    "70c3476dc8fb69f1a53c0a71f83781d002749805cfae63d17831d12b99460e5d": "BSD-3-Clause",
    "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da": "BSD-3-Clause",
    "7c16b387b2fd67aea7403110df9457eea9844b938eda62df5f98a56797001ccf": "BSD-3-Clause",
    "8403a35ce9fc298cc5cfdf4409fcc23cdd773c206bcb9ed6e71a26a589c9eb7c": "BSD-3-Clause",
    "84c781b5d7e3445d472ea78f86da8ce1f7cf3f8a699eed9e76e2fde2284fa9b6": "BSD-3-Clause",
    "85a253fdca75357d8f16143d242204d0c291650df54bf470a94c229f0d848c65": "BSD-3-Clause",
    "8d26c827c57e9949134066aae14944b8985df9512d64b06c63a52d24307a7e8d": "BSD-3-Clause",
    "96d1622876d511dd95d56bae14dc520796c725cf6fa27ebaa042979472a7e4a2": "BSD-3-Clause",
    "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2": "BSD-3-Clause",
    "9b9ac51f5ca1f4f99ccf94a0770c77723a9b4a5eaf09e0de3f8c9ec65b1f396d": "BSD-3-Clause",
    "9c07b35bff4c7723f05498d5016671e6aab167812efed57d22d711c2877f486b": "BSD-3-Clause",
    "a65aa119a9ae25139c00daa069f0ba1397cbaf52bc0cb15bce536c93c866827a": "BSD-3-Clause",
    "a9857077cb80439167b92c544f873efc646b1247b1f05825259ff4f7d9a6b28c": "BSD-3-Clause",
    "b8861cfac1c8c2ab18f520d9a97dff9e9f8e8891b7b0cc373d9e8ae198487a28": "BSD-3-Clause",
    "c07208b7ee8efdfe67a4850178e24b04d3509ab904c07a230bb97b52bdd07d88": "BSD-3-Clause",
    "c4720468a1dcf4f0a45f0c9331b48bc290a6615b73674b5e12181381ed50958b": "BSD-3-Clause",
    "c919c8359a6b1f2c6daec7cb9632dd22308088e7beeac81c65ebd67658f3e055": "BSD-3-Clause",
    "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15": "BSD-3-Clause",
    "ceb539a14a135648f303dbe38b2f990c43786bd70c95bbbfa427010d5444ec1f": "BSD-3-Clause",
    "da25bc36704e85b7df0251035f3b8de714fcb9a2b1ff874b672939c3063efac1": "BSD-3-Clause",
    "dd9c572087f92a74232343008a70468eeee08d97112450db549eb0fb33a8d29e": "BSD-3-Clause",
    "e1b73e8c38515d731ef64b668e8610ab9a70e7c75cacd01d00f8a4db52db0ca9": "BSD-3-Clause",
    "e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e": "BSD-3-Clause",
    "e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54": "BSD-3-Clause",
    "f57dfe6b2efee31dd50aee0b4e4abf6ebef5c367fc22989c9586f979c2aef14c": "BSD-3-Clause",
    "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af": "BSD-3-Clause",
    "fcfaca9856c9d06723391332be070f14157dc455699d40c8852a50b70f45fada": "BSD-3-Clause",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2",
    "aa8e67692652aa0ece49069f2f9dffde6690debb563e627bab22508062ff269c": "GFDL-1.2",
    "5b967c12b95f7d93d6f6004b6a40e177bcc0e67173d4cd222531f389cda0d765": "GFDL-1.3",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3",
    "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12": "GPL-1.0",
    "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc": "GPL-1.0",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5": "GPL-1.0",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3": "GPL-2.0",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0",
    "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2": "GPL-2.0",
    "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",
    "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19": "GPL-3.0",
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64": "GPL-3.0",
    "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2": "GPL-3.0",
    "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a": "ISC",
    "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1": "ISC",
    "280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29": "ISC",
    "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db": "ISC",
    "673f59dc8ad54524704b5b5d2deeb39eec917afad46597b1b7d4f2963edff317": "ISC",
    "8281b7122b87e54b97a6183786fef9b33350db9bfb9141855ea93e09543e1fcc": "ISC",
    "8ee0d4f927294d5cfe44a2a4b1faecb347cc94d0e53edd910b1abc0f6527865f": "ISC",
    "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee": "ISC",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "6e6982d8bb4468c5ce7a88e400f1540201513f39e8dd96e3607ee631b813c06f": "LGPL-2.0",
    "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688": "LGPL-2.0",
    "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c": "LGPL-2.0",
    "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4": "LGPL-2.1",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1",
    "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f": "LGPL-2.1",
    "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7": "LGPL-3.0",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "07a0c98d1dbf0062cedfbb5e38df91d8bd896a09ec198aa53c51fb2115592bd7": "MIT",
    "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c": "MIT",
    "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164": "MIT",
    "581c58dda46462468177d8af0224930878c4db1747d8d4e21c1067fb0f753199": "MIT",
    "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f": "MIT",
    "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127": "MIT",
    "74620107d78b567f655cb06d51f930a5e0e3cd3e1a2478bc7b860e678d8e447b": "MIT",
    "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4": "MIT",
    "ce56920e57e65aea4988a3d04f523bdceedd62176f0e66860fba85f85433a29b": "MIT",
    "204340b226fd810b187f231a87e223ea2dbfae06c8790568e1868cfecf8d4bac": "MPL-1.1",
    "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986": "MPL-1.1",
    "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6": "MPL-2.0",
    "f29410a4b9cf7ada059b5029550f39fe3cbfc5504fdab2a0b727735754430394": "MPL-2.0",
    "4f4764c3ad6a14dbec405182157578976513668d95ccff6a668e5338ef835fc1": "Unlicense",
    "8d3909f4543649cfba0b0b1fc765c67acf3736106a78237ea2972f83eaa7dd3e": "Unlicense",
    "e0a799e7d185f19d7fdcb7cb051a4177ef6512052fc563b932e65ca1e5805e14": "Unlicense",
}
